"""ratelens: PySpark-native analytics for insurance policy and ratemaking tables.

Public functions return DataFrames.  Most are lazy plans; ordering operators,
monitors and stores first run jobs whose results (counts, brackets, split
points) are small, and write what several plans read to the shared folder.
Sub-packages:

* ``functions``  column helpers and Column-expression builders
* ``sources``    table loading, the fixture ``policy`` view, monthly snapshot store
* ``operators``  segment summaries, distributed ranking/quantiles, pivots,
                 key-range co-partitioning, drift metrics, sketches, profiles, alerts
* ``plans``      the report catalogue and the drift monitors built from operators
"""

__version__ = "0.1.0"
