from ratelens.sources.tables import load_table, read_source
from ratelens.sources.policy import policy_frame, POLICY_SQL

__all__ = ["load_table", "read_source", "policy_frame", "POLICY_SQL"]
