"""Fill-in-middle, the Merkle manifest and toxicity against brute force, with nulls, ties, long texts and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_fixtures import CLASHING, SCHEMA, documents, lower_ascii, prose
from pyspark.sql import functions as F

from ratelens.llm import fill_middle, merkle_tree, queries, toxic_mil

ODD = [
    (900, "<P>sentinel <M> inside", "en", "src0", 5),
    (901, "ends <P", "en", None, None),
    (902, "x <", "en", None, 3),
    (903, "S> M> P> <", "en", "", 3),
    (None, "no id at all here", None, None, None),
    (None, "No Other Id", None, None, None),
    (904, "Ünïcödé 漢字 🙂 <S> x", "en", "src0", 9),
    (905, "tail space \n ", "en", "zz", 9),
    (905, "Same id, other text", "en", "zz", 9),
    (906, "only one of its source", "en", "lone", 1),
    *((k, f"Capital Letters {k}", "en", "src1", k) for k in range(910, 940)),
]
ROWS = documents() + ODD


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def wide(docs):
    names = [*CLASHING, "_key", "output", "form", "n", "tree", "idx", "bundle", "_part", "_at", "digest", "unit", "bad", "score", "toxic", "_order"]
    for c in dict.fromkeys(names):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    return docs


# fill in the middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc, len(tokens), "plain", None, None, text
    if h4 % 100 < 80:
        return doc, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle(docs, wide):
    want = sorted((brute_middle(r[0], r[1]) for r in ROWS), key=str)
    for table in (docs, wide):
        out = fill_middle.restore(fill_middle.transform(table)).collect()
        got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"].decode()) for r in out]
        assert sorted(got, key=str) == want
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


def test_middle_restores(docs):
    rows = fill_middle.restore(fill_middle.transform(docs, rate=100, spm=50, keep=["text", "lang"]))
    for r in rows.collect():
        assert r["restored"].decode() == (r["text"] or "")
    assert rows.columns == ["doc_id", "text", "lang", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]


def test_middle_every_cut():
    text = "a b  cé <\n🙂 d ".encode()
    for first in range(len(text) + 1):
        for second in range(first, len(text) + 1):
            p, m, s = text[:first], text[first:second], text[second:]
            for form, want in (("psm", b"<P>" + p + b"<S>" + s + b"<M>" + m), ("spm", b"<S>" + s + b"<P>" + p + b"<M>" + m)):
                out = bytes(fill_middle.arrange(text, first, second, form))
                assert out == want and fill_middle.rebuild(out, form) == text


def test_middle_clash_and_empty(spark, docs):
    with pytest.raises(ValueError):
        fill_middle.transform(docs.withColumn("form", F.lit(1)), keep=["form"])
    with pytest.raises(ValueError):
        fill_middle.restore(fill_middle.transform(docs), name="output")
    assert fill_middle.restore(fill_middle.transform(spark.createDataFrame([], SCHEMA))).count() == 0


def test_middle_string_ids(spark):
    got = fill_middle.transform(spark.createDataFrame([("a1", "one two three")], "doc_id string, text string")).first()
    assert got["output"].decode() == brute_middle("a1", "one two three")[-1] and got["doc_id"] == "a1"


# Merkle manifest


def hexed(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc, source, lang, n_chars, text):
    values = [None if v is None else str(v) for v in (doc, source, lang, n_chars, text)]
    return hexed(["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def brute_tree(nodes):
    """(root, the siblings of each node with its place, level by level)."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, at, strict=True):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            path.append((k % 16, run[: k % 16] + run[k % 16 + 1 :]))
        nodes = [hexed(nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def brute_manifest(rows):
    """The digests as a sorted list; of rows equal in doc_id and source, order by leaf."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, bytes.fromhex(brute_leaf(r[0], r[3], r[2], r[4], r[1])), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        group = sorted(by[s], key=lambda x: x[:3])
        trees.append((group, *brute_tree([x[2].hex() for x in group])))
    root, upper = brute_tree([t[1] for t in trees])
    out = []
    for (group, sub, paths), above in zip(trees, upper, strict=True):
        for (_, _, leaf, r), path in zip(group, paths, strict=True):
            path = path + above
            now = leaf.hex()
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = brute_leaf(r[0], r[3], r[2], r[4], None if r[1] is None else lower_ascii(r[1]))
            for at, others in path:
                now = hexed(others[:at] + [now] + others[at:])
            out.append((r[0], leaf.hex(), sub, root, hexed([d for _, o in path for d in o]), now, now == root))
    return sorted(out, key=str)


def manifest_rows(table):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle_tree.manifest(table, tampered).collect()
    text = [(r["doc_id"], *(r[c].hex() for c in ("leaf", "subroot", "root")), hexed([r["siblings"].hex()]), r["folded"].hex(), r["folded"] == r["root"]) for r in out]
    return sorted(text, key=str)


def test_manifest(docs, wide):
    want = brute_manifest(ROWS)
    assert manifest_rows(docs) == want
    assert manifest_rows(wide) == want
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("n", [1, 16, 17, 4096, 4097, 9000])
def test_manifest_rounds(spark, n):
    """A hot source of one to three superblocks beside small ones."""
    rnd = random.Random(n)
    rows = [(k, f"Text {rnd.random()}", "en", "hot", k) for k in range(n)]
    rows += [(n + k, "X", None, f"small{k}", k) for k in range(0 if n == 1 else 40)]
    assert manifest_rows(spark.createDataFrame(rows, SCHEMA)) == brute_manifest(rows)


def test_manifest_many_sources(spark):
    """More sources than a superblock holds."""
    rows = [(k, f"T{k}", "en", f"s{k % 4200}", k) for k in range(4400)]
    assert manifest_rows(spark.createDataFrame(rows, SCHEMA)) == brute_manifest(rows)


def test_manifest_proofs_fold(docs):
    """The stored proof alone folds a leaf to the root."""
    for r in merkle_tree.manifest(docs).collect():
        path = merkle_tree.unpacked(bytes(r["places"]), bytes(r["siblings"]))
        assert merkle_tree.fold(bytes(r["leaf"]), path) == r["root"] == r["folded"]


def test_manifest_empty(spark):
    assert merkle_tree.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


# toxicity

INSULTS = {"en": "numbskull", "xx": "gruntz"}


def bags(seed, n):
    """(doc_id, text, toxic): some sentences of a toxic text insult, by a word or an inflected stem."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        toxic = int(rnd.random() < 0.3)
        lines = [prose(rnd, rnd.choice([4, 9, 14])) + "." for _ in range(rnd.choice([1, 3, 20]))]
        if toxic:
            at = rnd.randrange(len(lines))
            lines[at] = f"You {rnd.choice(['numbskull', 'gruntz' + rnd.choice('abcdefghij') + rnd.choice('klmno')])} there."
        out.append((k, "\n".join(lines), toxic))
    return out


@pytest.fixture(scope="module")
def taught(spark):
    rows = bags(5, 500)
    texts = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows[:350]], "doc_id long, quality int, toxic int")
    return rows, texts, labels, toxic_mil.fit(texts, labels)


def test_toxic_held_out(taught):
    rows, texts, _, model = taught
    got = {r["doc_id"]: r for r in toxic_mil.score(texts, model).collect()}
    wrong = [r for r in rows[350:] if (got[r[0]]["score"] >= 0.3) != bool(r[2])]
    assert len(wrong) <= 3
    for r in rows[350:]:
        if r[2] and got[r[0]]["score"] >= 0.3:
            blamed = " ".join(r[1][s["start"] : s["end"]] for s in got[r[0]]["offending"])
            assert "numbskull" in blamed or "gruntz" in blamed


def test_toxic_noisy_or(taught):
    """Scores follow from the model by the stated formula."""
    rows, texts, _, model = taught
    got = {r["doc_id"]: r["score"] for r in toxic_mil.score(texts, model).collect()}
    for doc, text, _ in rows[:60]:
        rest = 1 - model.leak
        for line in re.split(r"\n|(?<=[.!?])\s", text):
            words = set(re.findall(r"\w+", line.lower()))
            if words:
                s = model.bias
                for w in words:
                    s += sum(model.weights.get(f, 0.0) for f in ["=" + w] + [w[:k] for k in range(3, 8) if len(w) >= k])
                rest *= 1 - 1 / (1 + np.exp(-s))
        assert got[doc] == pytest.approx(1 - rest, abs=1e-9)


def test_toxic_labels_only_teach(spark, taught):
    """Scores don't depend on held-out labels, partitions or other columns."""
    _, texts, labels, model = taught
    again = toxic_mil.fit(texts.repartition(7).withColumn("toxic", F.lit("own")).withColumn("_order", F.lit(1)), labels.repartition(5))
    assert again.weights == model.weights and again.bias == model.bias
    repeated = labels.unionByName(labels.limit(20)).unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None)], labels.schema))
    assert toxic_mil.fit(texts, repeated).weights == model.weights


def test_toxic_bounds(taught):
    _, texts, labels, _ = taught
    assert toxic_mil.sample(texts, labels, max_rows=40).count() == 40
    taken = toxic_mil.sample(texts, labels, max_bytes=9000).collect()
    assert taken and sum(len(r["text"].encode()) for r in taken) <= 9000


def test_toxic_edges(spark, taught, wide):
    _, texts, labels, model = taught
    rows = [(1, None), (2, ""), (3, " \n.!? "), (None, "numbskull!"), (4, "numbskull " * 30000), (4, "fine words. " * 50000)]
    got = toxic_mil.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    by = {(r["doc_id"], k): r for k, r in enumerate(got)}
    assert len(got) == 6 and {k[0] for k in by} == {1, 2, 3, 4, None}
    assert [r["score"] for r in got if r["doc_id"] in (1, 2, 3)] == [pytest.approx(model.leak)] * 3
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["score"] >= 0.3 for r in got if r["doc_id"] == 4) >= 1
    assert toxic_mil.score(wide, model).count() == len(ROWS)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxic_mil.score(none, toxic_mil.fit(none, labels)).count() == 0
    assert toxic_mil.fit(texts, labels.where("toxic = 0")).leak == 0.0
    assert [s for s in toxic_mil.sentences("a.b.c. d! e\nf。g")] == [(0, 6, {"a", "b", "c"}), (6, 9, {"d"}), (9, 11, {"e"}), (12, 14, {"f"}), (14, 15, {"g"})]


def test_toxic_query(spark):
    """Held-out labels of the given table."""
    sf = "/root/testdata/sf0.01"
    out = queries.toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in out if r["toxic"]]
    clean = [r for r in out if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.05 * len(clean)
