"""Personal data: fixed patterns, and further spans by weak supervision.

Base spans (email, ip, card, phone) are found by pattern and checks.  Other
candidates are identifier-like tokens (runs of letters, digits, ``_`` and ``-``
with at least four digits).  Four labelers vote on each:

* ``shape``     regex: letters and digits mixed, 16 characters or more,
* ``gazetteer`` a credential or identity word stands just before it,
* ``context``   an assignment sign or quote stands just before it,
* ``random``    letters and digits alternate often.

Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability for private and other tokens and the patterns'
posteriors.  A logistic regression on the tokens' own features (length, digit
share, alternation, case, what stands before) is trained on these posteriors
and decides on each token; those it calls private become ``secret`` spans
unless they overlap a base span.

Both models are fitted on counts over all documents: at most 16 vote patterns
and a bounded number of feature patterns reach the driver.  Everything else is
DataFrame functions, one row per document, without a shuffle but for the counts.

Positions come from marking matches with a control character, splitting there
and adding up lengths.  Control characters U+0001 to U+0005 in a text are
replaced by U+0006 first, which no pattern matches; lengths stay.  Repeated
groups are written as classes over marked separators, so that no regular
expression recurses or backtracks over a long text.

Defined results: a null text is an empty one; repeated rows are judged each;
overlaps between base kinds all stay; a table without candidates adds no spans;
an empty table gives an empty result; ``mask`` keeps the input's columns and no
other and sets ``n_chars``, where there is one, to the new length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.shared import free_name

KINDS = ("email", "ip", "card", "phone", "secret")
MARK, SEPARATOR, DOT = "\x01", "\x03", "\x04"
#: Parts whose lengths are added up in one array.
CHUNK = 1000

#: Words that announce a credential or an identity number.
GAZETTEER = (
    "token", "secret", "password", "passwd", "passphrase", "apikey", "api_key", "api-key", "access_key", "key",
    "auth", "authorization", "bearer", "credential", "session", "cookie", "signature", "ssn", "iban", "account",
    "passport", "licence", "license", "tax_id", "vat",
)
LABELERS = ("shape", "gazetteer", "context", "random")

EMAIL = rf"(?:(?<![A-Za-z0-9._%+{DOT}-])|\G)[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{SEPARATOR}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
RUN = "[A-Za-z_-]*+[0-9]"
CANDIDATE = rf"(?<![A-Za-z0-9_-])(?={RUN}{RUN}{RUN}{RUN})[A-Za-z0-9_-]{{8,}}+"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def prefix_sums(lens: Column) -> Column:
    """Sums of all elements before each element; arrays grow in chunks, so long ones cost no square."""

    def within(a: Column, base: Column) -> Column:
        start = F.struct(base.alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            a, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")), lambda s: s["out"]
        )

    def chunked(a: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int"))
        chunks = F.transform(numbers, lambda k: F.slice(a, k * CHUNK + 1, CHUNK))
        return let(
            chunks,
            lambda cs: let(
                within(F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)), F.lit(0)),
                lambda bases: F.flatten(F.transform(cs, lambda c, k: within(c, bases[k]))),
            ),
        )

    return let(lens, lambda a: F.when(F.size(a) <= CHUNK, within(a, F.lit(0))).otherwise(chunked(a)))


def parts(text: Column, pattern: str, guard: str) -> Column:
    """The text in turn outside and inside the pattern's matches; unsplit where ``guard`` isn't found."""
    marked = lambda t: F.regexp_replace(t, f"(?:{pattern})", f"{MARK}$0{MARK}")
    return let(text, lambda t: F.when(t.rlike(guard), F.split(marked(t), MARK, -1)).otherwise(F.array(t)))


def matches(cut: Column) -> Column:
    """Array of (start, end, value, before) of the odd parts; before: up to 40 characters."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")

    def spans(p: Column, starts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)),
            lambda i: F.struct(
                starts[i].alias("start"),
                (starts[i] + F.length(p[i])).alias("end"),
                p[i].alias("value"),
                F.right(p[i - 1], F.lit(40)).alias("before"),
            ),
        )

    return let(
        cut, lambda p: F.when(F.size(p) > 1, let(prefix_sums(F.transform(p, F.length)), lambda s: spans(p, s))).otherwise(none)
    )


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]++", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    from_right = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.transform(from_right, lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda s, x: s + x
    )
    return total % 10 == 0


def small_part(x: Column) -> Column:
    plain = F.regexp_replace(x, "^0++", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def is_card(value: Column) -> Column:
    return let(digits(value), lambda n: F.when(F.length(n).between(16, 19), luhn(n)).otherwise(False))


def cleaned(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike("[\x01-\x05]"), F.regexp_replace(text, "[\x01-\x05]", "\x06")).otherwise(text)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans by kind of a cleaned text."""
    dotted = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)).otherwise(text)
    spaced = F.when(text.rlike("[0-9][ -][0-9]"), F.regexp_replace(text, "(?<=[0-9])[ -](?=[0-9])", SEPARATOR)).otherwise(text)
    return {
        "email": matches(parts(dotted, EMAIL, "@")),
        "ip": F.filter(
            matches(parts(text, IP, r"[0-9]\.[0-9]")), lambda m: F.forall(F.split(m["value"], r"\."), small_part)
        ),
        "card": F.filter(matches(parts(spaced, CARD, "[0-9]")), lambda m: is_card(m["value"])),
        "phone": F.filter(
            matches(parts(text, PHONE, r"\+[0-9]")), lambda m: F.length(digits(m["value"])).between(8, 15)
        ),
    }


def alternations(value: Column) -> Column:
    return F.regexp_count(value, F.lit("[0-9](?=[A-Za-z])")) + F.regexp_count(value, F.lit("[A-Za-z](?=[0-9])"))


def announced(before: Column) -> Column:
    return F.lower(before).rlike("(?:" + "|".join(GAZETTEER) + r")[^a-z0-9]{0,5}$")


def assigned(before: Column) -> Column:
    return before.rlike("[=:\"'`]\\s?$")


def votes(c: Column) -> Column:
    """The labelers' votes as bits, in the order of LABELERS."""
    value = c["value"]
    found = (
        (F.length(value) >= 16) & value.rlike("[A-Za-z]") & value.rlike("[0-9]"),
        announced(c["before"]),
        assigned(c["before"]),
        alternations(value) >= 5,
    )
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(found)), F.lit(0))


#: Feature name -> (number of levels, level of a candidate).
FEATURES = {
    "length": (5, lambda c: _level(F.length(c["value"]), 12, 16, 24, 40)),
    "digits": (4, lambda c: _level(F.floor(F.length(digits(c["value"])) * 100 / F.length(c["value"])), 40, 70, 100)),
    "alternating": (4, lambda c: _level(alternations(c["value"]), 1, 4, 8)),
    "case": (3, lambda c: F.when(c["value"].rlike("[a-z]"), 1).otherwise(0) + F.when(c["value"].rlike("[A-Z]"), 1).otherwise(0)),
    "announced": (2, lambda c: F.when(announced(c["before"]), 1).otherwise(0)),
    "assigned": (2, lambda c: F.when(assigned(c["before"]), 1).otherwise(0)),
}


def _level(x: Column, *bounds: int) -> Column:
    return sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def candidates(text: Column) -> Column:
    return matches(parts(text, CANDIDATE, "[0-9]"))


def reliabilities(counts: dict[int, int], rounds: int = 200) -> tuple[float, list[tuple[float, float]], dict[int, float]]:
    """EM over vote patterns: share of private tokens, each labeler's (vote if private, vote if other), posteriors."""
    total = sum(counts.values())
    # start: a token is private as far as labelers vote for it
    post = {v: max(0.02, min(0.98, (bin(v).count("1") - 0.5) / (len(LABELERS) - 1))) for v in counts}
    share, rates = 0.5, [(0.5, 0.5)] * len(LABELERS)
    for _ in range(rounds if total else 0):
        private = sum(n * post[v] for v, n in counts.items())
        share = (private + 0.5) / (total + 1)
        rates = [
            (
                (sum(n * post[v] for v, n in counts.items() if v >> k & 1) + 0.5) / (private + 1),
                (sum(n * (1 - post[v]) for v, n in counts.items() if v >> k & 1) + 0.5) / (total - private + 1),
            )
            for k in range(len(LABELERS))
        ]
        for v in counts:
            yes, no = share, 1 - share
            for k, (p, q) in enumerate(rates):
                yes *= p if v >> k & 1 else 1 - p
                no *= q if v >> k & 1 else 1 - q
            post[v] = yes / (yes + no)
    return share, rates, post


@dataclass
class SpanModel:
    """What training gives; ``weights``: by feature and level."""

    share: float
    rates: list[tuple[float, float]]
    intercept: float
    weights: dict[str, list[float]]

    def is_private(self, c: Column) -> Column:
        z = F.lit(self.intercept)
        for name, (_, level) in FEATURES.items():
            z = z + F.element_at(F.array(*map(F.lit, self.weights[name])), level(c) + 1)
        return z > 0


def train(docs: DataFrame) -> SpanModel:
    """Reliabilities and the span classifier, from counts over all documents."""
    found = docs.select(F.explode(candidates(cleaned(F.col("text")))).alias("c"))
    levels = [level(F.col("c")).cast("int").alias(name) for name, (_, level) in FEATURES.items()]
    # at most 16 x the product of the levels, whatever the input
    rows = found.select(votes(F.col("c")).alias("votes"), *levels).groupBy("votes", *FEATURES).count().collect()
    counts: dict[int, int] = {}
    for r in rows:
        counts[r["votes"]] = counts.get(r["votes"], 0) + r["count"]
    share, rates, post = reliabilities(counts)
    none = {name: [0.0] * n for name, (n, _) in FEATURES.items()}
    if not rows:
        return SpanModel(share, rates, -1.0, none)
    examples = []
    for r in rows:
        one_hot = Vectors.dense([float(r[name] == k) for name, (n, _) in FEATURES.items() for k in range(n)])
        p = post[r["votes"]]
        examples += [(1.0, r["count"] * p, one_hot), (0.0, r["count"] * (1 - p), one_hot)]
    frame = docs.sparkSession.createDataFrame(examples, ["label", "weight", "features"])
    fitted = LogisticRegression(weightCol="weight", regParam=0.01, standardization=False, maxIter=50).fit(frame.coalesce(1))
    flat, weights, at = fitted.coefficients.toArray().tolist(), {}, 0
    for name, (n, _) in FEATURES.items():
        weights[name] = flat[at : at + n]
        at += n
    return SpanModel(share, rates, float(fitted.intercept), weights)


SPANS = "array<struct<start:int,end:int>>"


def with_spans(docs: DataFrame, model: SpanModel, to: str) -> DataFrame:
    """``docs`` with a struct column: kind -> array of (start, end)."""
    text = free_name([*docs.columns, to], "_cleaned")
    found = free_name([*docs.columns, to, text], "_found")
    rows = docs.withColumn(text, cleaned(F.col("text")))
    rows = rows.withColumn(found, F.struct(*(s.alias(k) for k, s in base_spans(F.col(text)).items()), candidates(F.col(text)).alias("more")))
    base = F.concat(*(F.col(f"{found}.{k}") for k in KINDS[:-1]))
    free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    more = F.filter(F.col(f"{found}.more"), lambda c: model.is_private(c) & free(c))
    bare = lambda spans: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    kinds = [bare(F.col(f"{found}.{k}")).alias(k) for k in KINDS[:-1]] + [bare(more).alias("secret")]
    return rows.withColumn(to, F.struct(*kinds)).drop(text, found)


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, comma-joined."""

    def named(kind: str) -> Column:
        return F.transform(spans[kind], lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def find(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_secret, base (joined base spans), spans (all)."""
    model = model or train(docs)
    rows = with_spans(docs.select("doc_id", "text"), model, "found")
    found = F.col("found")
    return rows.select(
        "doc_id",
        *(F.size(found[k]).cast("long").alias(f"n_{k}") for k in KINDS),
        joined(found, KINDS[:-1]).alias("base"),
        joined(found, KINDS).alias("spans"),
    )


def mask(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with each span's text replaced by its kind in brackets; overlapping spans become one."""
    model = model or train(docs)
    columns = docs.columns
    spans = free_name(columns, "_spans")
    rows = with_spans(docs, model, spans)
    one = lambda k: F.transform(F.col(spans)[k], lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("tag")))
    every = F.array_sort(F.concat(*(one(k) for k in KINDS)))
    merged = F.aggregate(
        every,
        F.array().cast("array<struct<start:int,end:int,tag:string>>"),
        lambda out, m: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] > m["start"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(
                    F.struct(
                        F.try_element_at(out, F.lit(-1))["start"].alias("start"),
                        F.greatest(F.try_element_at(out, F.lit(-1))["end"], m["end"]).alias("end"),
                        F.try_element_at(out, F.lit(-1))["tag"].alias("tag"),
                    )
                ),
            ),
        ).otherwise(F.concat(out, F.array(m))),
    )
    whole = free_name([*columns, spans], "_merged")
    rows = rows.withColumn(whole, F.when(F.size(every) > 0, merged))
    m = F.col(whole)
    before = F.transform(
        m, lambda x, i: F.concat(F.substring(F.col("text"), F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0) + 1, x["start"] - F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0)), x["tag"])
    )
    rest = F.substring(F.col("text"), F.element_at(m, -1)["end"] + 1, F.length("text"))
    rows = rows.withColumn("text", F.when(m.isNotNull(), F.concat(F.array_join(before, ""), rest)).otherwise(F.col("text")))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(m.isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rows.select(*columns)
