"""The operators against brute force on a small table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_fixtures import CLASHING, SCHEMA, base_spans, components_of, documents, jaccard_classes, lower_ascii, words_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratelens.llm import (
    bpe_words,
    chunks,
    embed_lsh,
    jaccard_join,
    lm_backoff,
    pack_bestfit,
    pii_weak,
    quality_fertility,
    shard_lpt,
    substring_lines,
    url_rules,
)
from ratelens.llm.queries import BYTE_BPE_JSON, BYTE_BPE_RANKS, PIECE_BPE, URL_RULES

ROWS = documents()
TEXT = {r[0]: r[1] for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def wide(docs):
    """The documents with columns whose names the operators use themselves."""
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    return docs


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    """The documents as a table of files."""
    path = str(tmp_path_factory.mktemp("llm") / "documents.parquet")
    docs.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], r)
    return out


# 1 -- language-model scores


def brute_scores(rows, order, backoff):
    docs = [words_of(r[1]) for r in rows]
    counts = [Counter() for _ in range(order)]
    own = [[Counter() for _ in range(order)] for _ in docs]
    for d, w in enumerate(docs):
        for n in range(order):
            for i in range(len(w) - n):
                counts[n][tuple(w[i : i + n + 1])] += 1
                own[d][n][tuple(w[i : i + n + 1])] += 1
    total = sum(map(len, docs))

    def s(d, gram):
        n = len(gram) - 1
        c = counts[n][gram] - own[d][n][gram]
        if n == 0:
            others = total - len(docs[d])
            return c / others if c > 0 else 1 / (others + 1)
        if c > 0:
            return c / (counts[n - 1][gram[:-1]] - own[d][n - 1][gram[:-1]])
        return backoff * s(d, gram[1:])

    return [sum(math.log10(s(d, tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w))) for d, w in enumerate(docs)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, stored, order):
    got = sorted((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in lm_backoff.score(stored, order=order).collect())
    want = sorted((r[0], len(words_of(r[1])), round(s, 6)) for r, s in zip(ROWS, brute_scores(ROWS, order, 0.4), strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-5)


def test_scores_empty(none):
    assert lm_backoff.score(none).collect() == []


# 2 -- url filters

URLS = [
    "https://www.Example.com/en/1?a=b",
    "http://example.com/en/2#x",
    "http://a.example.com/en/3",
    "https://b.org.net/es/4",
    "https://net/fr/",
    "https://x.net/en/5",
    "https://y.org/fr/6?utm=1",
    "https://notexample.com/en/",
    "https://example.com",
    "https://example.com?x://y/z",
    "no scheme /en/",
    "://h/p?q",
    "",
    None,
]


def listed(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = lower_ascii(host)
    fits = []
    for rule in URL_RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    rows = [(k, u, "x") for k, u in enumerate(URLS * 3)]
    rows += rows[:4]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_rules.judge_pages(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule = listed(URLS[r["page_id"] % len(URLS)])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == URL_RULES[rule] if rule else r["verdict"] in ("allow", "block")
    assert url_rules.judge_pages(pages.limit(0), URL_RULES).collect() == []


def test_mined_rules(spark):
    """Rules keep support and confidence, and decide on unlisted urls."""
    bad = [(k, f"https://s{k}.net/es/casino/{k}") for k in range(30)]
    good = [(100 + k, f"https://s{k}.com/news/{k}") for k in range(30)]
    other = [(200, "https://q.org/casino/1"), (201, "https://q.org/news/1"), (202, "https://q.org/else/1")]
    pages = spark.createDataFrame(bad + good + other, "page_id long, url string")
    got = {r["page_id"]: r for r in url_rules.judge_pages(pages, URL_RULES).collect()}
    assert [got[k]["verdict"] for k in (200, 201, 202)] == ["block", "allow", "allow"]
    assert got[200]["mined"] == "p:casino" and got[202]["mined"] is None
    labelled = spark.createDataFrame([(["a", "b"], "block")] * 6 + [(["a"], "allow")] * 4, "tokens array<string>, label string")
    rules = {(r["key"], r["label"]): r for r in url_rules.mined_rules(labelled, 0.1, 0.5).collect()}
    # {a, b} -> block is no more confident than {b} -> block
    assert set(rules) == {("a", "block"), ("b", "block")}
    assert rules["a", "block"]["confidence"] == 0.6 and rules["b", "block"]["confidence"] == 1.0


# 3 -- sharding


def test_shards(docs, none):
    rows = shard_lpt.shard_documents(docs, 7).collect()
    assert len(rows) == len(ROWS)
    load, slots, home = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (TEXT[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        home[TEXT[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in home.values())
    sizes = Counter()
    for r in ROWS:
        sizes[r[1]] += len((r[1] or "").encode()) + 16
    assert max(load.values()) - min(load.get(s, 0) for s in range(7)) <= max(sizes.values())
    assert shard_lpt.shard_documents(none).collect() == []


def test_shards_bundled(docs):
    """Few bundles: groups still stay whole and every row is placed."""
    rows = shard_lpt.shard_documents(docs, 3, bundles_per_shard=2).collect()
    home = defaultdict(set)
    for r in rows:
        home[TEXT[r["doc_id"]]].add(r["shard"])
    assert len(rows) == len(ROWS) and all(len(s) == 1 for s in home.values())


def test_lpt():
    assert shard_lpt.lpt([(5, 1), (5, 2), (4, 3), (3, 4), (3, 5)], 2) == {1: 0, 2: 1, 3: 0, 4: 1, 5: 1}


# 4 -- quality


def brute_quality(text):
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, none):
    got = quality_fertility.judge(docs, BYTE_BPE_RANKS, PIECE_BPE).collect()
    assert len(got) == len(ROWS)
    for r in got:
        n, chars, symbols, lines, repeats = brute_quality(TEXT[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (r["kept"] and r["base_failed"])
    assert any(r["kept"] for r in got)
    assert quality_fertility.judge(none, BYTE_BPE_RANKS, PIECE_BPE).collect() == []


def brute_verdict(text, bpe, pieces):
    """Script and verdict, by encoding every word and reading the bands as they are stated."""
    words = words_of(text)
    ids = [i for w in words for i in bpe.encode_ordinary(" " + w)]
    parts = [i for w in words for i in pieces.encode(w)]
    letters = {k: sum(len(p.findall(w)) for w in words) for k, p in quality_fertility.SCRIPT_OF.items()}
    script = max(letters, key=letters.get) if any(letters.values()) else "other"
    share = [n / len(ids) for n in Counter(ids).values()]
    values = {
        "chars_per_token": sum(map(len, words)) / len(ids) if ids else 0,
        "byte_share": sum(map(pieces.is_byte, parts)) / len(parts) if parts else 0,
        "token_entropy": -sum(p * math.log2(p) for p in share) if len(ids) >= 100 else None,
        "symbols_per_word": sum(c in "#*$%&|<>" for c in text or "") / len(words) if words else 0,
    }
    fits = [v is None or ((lo is None or v >= lo) and (hi is None or v <= hi)) for v, (lo, hi) in ((values[k], b) for k, b in quality_fertility.BANDS[script].items())]
    n, _, _, _, repeats = brute_quality(text)
    return script, n >= 50 and 100 * repeats <= 50 * n and all(fits)


def test_quality_verdict(spark):
    """Scripts by letters alone, so numbers beside words of another script don't make a text latin; verdicts by brute force."""
    ranks = open(BYTE_BPE_RANKS, "rb").read()
    m = quality_fertility.WordMeasures(ranks, open(PIECE_BPE, "rb").read())
    rnd = np.random.default_rng(3)
    vocab = {
        "latin": ["house", "river", "the", "and", "because", "l'été", "x2"],
        "cyrillic": ["цена", "товар", "рубль", "город"],
        "cjk": ["价格", "商品", "東京", "한국"],
        "greek": ["τιμή", "πόλη"],
        "other": ["12", "3.50", "--"],
    }
    texts = []
    for own in vocab:
        for n in (40, 60, 200):
            for numbers in (0, 1, 2):
                words = [vocab[own][k] + "абвгд"[j % 5] * (own == "cyrillic") for j, k in enumerate(rnd.integers(0, len(vocab[own]), n))]
                texts.append(" ".join(w + f" {rnd.integers(10**6)},{rnd.integers(100):02d}" * numbers for w in words))
    texts += [" ".join(f"{w}#" for w in t.split()) for t in texts[2:4]] + [None, ""]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: (r["script"], r["kept"]) for r in quality_fertility.judge(docs, BYTE_BPE_RANKS, PIECE_BPE).collect()}
    assert got == {k: brute_verdict(t, m.bpe, m.pieces) for k, t in enumerate(texts)}
    assert {s for s, _ in got.values()} == set(vocab) and {k for _, k in got.values()} == {True, False}


def test_removals_spread_a_hot_line(spark):
    """A line that many documents share is joined by salt and found in each of them but the first."""
    line = " ".join(f"word{k}" for k in range(25))
    rows = [(k, f"own text of document {k}\n{line}" if k % 3 else line, "en", "s", 1) for k in range(500)] * 2
    got = substring_lines.removals(spark.createDataFrame(rows, SCHEMA)).collect()
    at = {k: len(f"own text of document {k}\n") if k % 3 else 0 for k in range(500)}
    assert sorted((r["doc_id"], r["start"], r["first_doc"], r["first_start"]) for r in got) == [(k, at[k], 0, 0) for k in range(1, 500)]


def test_quality_keep(wide):
    kept = quality_fertility.keep(wide, BYTE_BPE_RANKS, PIECE_BPE)
    assert kept.schema == wide.schema
    verdicts = quality_fertility.judge(wide, BYTE_BPE_RANKS, PIECE_BPE).where("kept")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in verdicts.collect())


def test_fertility_measures():
    m = quality_fertility.WordMeasures(open(BYTE_BPE_RANKS, "rb").read(), open(PIECE_BPE, "rb").read())
    row = quality_fertility.measured(m, ["hello hello 𐐐".encode()], quality_fertility.BANDS, 1)[0]
    ids = [i for w in ("hello", "hello", "𐐐") for i in m.bpe.encode_ordinary(" " + w)]
    counts = np.array(list(Counter(ids).values())) / len(ids)
    assert row[5] == len(ids)
    assert row[6] == pytest.approx(11 / len(ids))
    assert row[8] == pytest.approx(-(counts * np.log2(counts)).sum())
    assert row[7] > 0  # the rare letter falls back to bytes
    strange = ("\U00010450\U00010451 " * 60).encode()
    assert quality_fertility.measured(m, [strange], quality_fertility.BANDS, 1)[0][7] > 0.5


# 5 -- embeddings


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(80):
        rows.append(rng.standard_normal(16))
    for k in range(40):
        rows.append(rows[k % 10] + rng.standard_normal(16) * 0.05 * (k % 7))
    rows += [rows[3]] * 20 + [rows[4] * 2.5, -rows[4]]
    out = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]
    n = len(out)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    return out + [(n + k, v) for k, v in enumerate(odd)]


def brute_vectors(rows, least):
    good = {}
    for k, v in rows:
        if v and None not in v and all(map(math.isfinite, v)) and any(v):
            good[k] = np.array(v, np.float32).astype(float)
    links = []
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    links.append((a, b))
    comp = components_of([k for k, _ in rows], links)
    degree = Counter(x for p in links for x in p)
    return {k: (degree[k], comp[k]) for k, _ in rows}


@pytest.mark.parametrize("block", [2048, 7])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embed_lsh, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("own"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_lsh.near_duplicates(df).collect()}
    want = brute_vectors(rows, 0.95)
    assert got == want
    assert embed_lsh.near_duplicates(df.limit(0)).collect() == []


# 6 -- packing


def test_packing(docs, none):
    got = pack_bestfit.pack_documents(docs, BYTE_BPE_JSON, capacity=256, ids=True).collect()
    own = Tokenizer.from_file(BYTE_BPE_JSON)
    own.encode_special_tokens = True
    whole = {k: [*own.encode(t or "", add_special_tokens=False).ids, 0] for k, t in TEXT.items()}
    repeated = Counter(r[0] for r in ROWS)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and 1 <= r["length"] <= 256
    for k, ids in whole.items():
        n = -(-len(ids) // 256)
        assert sorted(r["piece"] for r in pieces[k]) == sorted(list(range(n)) * repeated[k])
        assert all(r["length"] == 256 for r in pieces[k] if r["piece"])
        assert sum(r["length"] for r in pieces[k]) == len(ids) * repeated[k]
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    tokens = sum(len(whole[r[0]]) for r in ROWS)
    assert len(sequences) <= 1.05 * tokens / 256 + 2
    assert pack_bestfit.pack_documents(none, BYTE_BPE_JSON).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_plan_covers_all_and_fits(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(129, np.int64)
    for n in np.clip(rng.lognormal(3, 1, 500 * seed + 3).astype(int), 1, 128):
        counts[n] += 1
    sequences = defaultdict(list)
    seen = Counter()
    for length, a, b, first, per, offset in pack_bestfit.best_plan(counts):
        for k in range(b - a):
            sequences[first + k // per].append((offset + k % per * length, length))
            seen[length, a + k] += 1
    assert set(seen.values()) <= {1} and sum(seen.values()) == counts.sum()
    for s in sequences.values():
        s.sort()
        assert all(o == sum(n for _, n in s[:i]) for i, (o, _) in enumerate(s)) and sum(n for _, n in s) <= 128
    assert sorted(sequences) == list(range(len(sequences)))
    volume = int((np.arange(129) * counts).sum())
    assert len(sequences) <= 1.08 * volume / 128 + 2


# 7 -- byte-level BPE


def test_byte_bpe(stored, none):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_words.ranks_of(open(BYTE_BPE_RANKS, "rb").read()), special_tokens={})
    got = bpe_words.digests(stored, BYTE_BPE_RANKS, P.PATTERN).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = TEXT[r["doc_id"]] or ""
        ids = np.array(own.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_words.digests(none, BYTE_BPE_RANKS, P.PATTERN).collect() == []


def test_decode_joins_bytes(stored):
    encoded = bpe_words.encode(stored, BYTE_BPE_RANKS, P.PATTERN)
    for r in bpe_words.decode(encoded, BYTE_BPE_RANKS).collect():
        assert r["bytes"].decode() == (TEXT[r["doc_id"]] or "")


def test_small_blocks(stored, monkeypatch):
    monkeypatch.setattr(bpe_words, "BLOCK_BYTES", 3000)
    for r in bpe_words.encode(stored, BYTE_BPE_RANKS, P.PATTERN, decoded=True).collect():
        assert r["bytes"].decode() == (TEXT[r["doc_id"]] or "")


def test_chunks_are_independent():
    """Any cut of white space gives the ids of the whole text, in both libraries."""
    import random

    import pyarrow as pa

    rnd = random.Random(7)
    bits = [" "] * 6 + ["a", "the", " the", "\n", "\t", "\r", "\x0b", " ", "é", "12", ".", "!!", "'s", "'ll", "'", "\0", "<|endoftext|>", "漢", "🙂", "\x1c", "\x85", "\u3000", "e\u0301"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    own = Tokenizer.from_file(BYTE_BPE_JSON)
    own.encode_special_tokens = True
    enc = pack_bestfit.ChunkEncoder(open(BYTE_BPE_JSON, "rb").read())
    split = bpe_words.Splitter(P.PATTERN)
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        words, numbers = split.block([t.encode() for t in part])
        for t, ids, n in zip(part, enc.encode(pa.array(part, pa.string())), numbers, strict=True):
            assert ids.tolist() == own.encode(t, add_special_tokens=False).ids
            assert [words[i] for i in n] == split.find(t)
    assert chunks.unusual_keys("  a b") == ["\0 ", "\0 a", "\0 b"]


# 8 -- n-gram Jaccard join


@pytest.mark.parametrize("size,least", [(3, 90), (5, 80), (1, 50)])
def test_jaccard(docs, none, size, least):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_classes(docs, size, least).collect()}
    assert got == jaccard_classes(ROWS, size, least)
    assert jaccard_join.join_classes(none, size, least).collect() == []


def test_jaccard_in_blocks(docs, monkeypatch):
    """Groups compared pairwise, in blocks of three."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_classes(docs, 2, 85).collect()}
    assert got == jaccard_classes(ROWS, 2, 85)


def test_sketches_bound_differences():
    rng = np.random.default_rng(6)
    for n, k in ((5, 1), (60, 9), (70, 3), (1000, 200)):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        b = np.unique(np.concatenate([a[k:], rng.integers(0, 1 << 64, k + 20, np.uint64)]))
        x, y = jaccard_join.folded([jaccard_join.sketch_of(a), jaccard_join.sketch_of(b)])
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_signatures_lose_no_link():
    """Random sets at the threshold, of all sizes, share a signature."""
    rng = np.random.default_rng(5)
    for least in (50, 80, 90):
        for others in (1, 10**6):
            bands = jaccard_join.Bands(least)
            for b in range(200):
                bands.sets[b] = others
            for _ in range(400):
                n = int(rng.choice([1, 2, 3, 5, 9, 10, 11, 15, 19, 20, 30, 64, 200]))
                both = rng.integers(0, 1 << 64, n, np.uint64)
                spare = (100 - least) * n // least  # most differing shingles for this overlap
                k = int(rng.integers(0, spare + 1))
                a = np.unique(np.concatenate([both, rng.integers(0, 1 << 64, k, np.uint64)]))
                b = np.unique(np.concatenate([both, rng.integers(0, 1 << 64, spare - k, np.uint64)]))
                assert 100 * n >= least * (len(a) + len(b) - n)
                s, t = jaccard_join.signatures(a, bands), jaccard_join.signatures(b, bands)
                assert len(np.intersect1d(s, t)), (least, n, k, spare)


def test_jaccard_keeps_one(wide, spark):
    kept = jaccard_join.keep_one(wide, 5, 80)
    assert kept.columns == wide.columns
    classes = jaccard_classes(ROWS, 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, (_, c) in classes.items() if k == c)
    anonymous = spark.createDataFrame([(None, "some words here", "en", "s", 1)] * 2 + [(1, "some words here", "en", "s", 1)], SCHEMA)
    assert [r["doc_id"] for r in jaccard_join.keep_one(anonymous, 5, 80).collect()] == [1]


def test_jaccard_keeps_texts_of_one_id(spark):
    """Rows that share an id, or have none, stay unless their texts are of one group; a column _id is no matter."""
    one, two = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven"
    rows = [(1, one), (1, two), (1, one), (2, two), (None, one), (None, two + " eight nine ten"), (None, two + " eight nine ten"), (3, None), (3, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit("own")).withColumn("_t1", F.lit(1))
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs, 5, 80).collect()), key=str)
    assert got == sorted([(1, one), (1, two), (None, two + " eight nine ten"), (3, None), (3, "")], key=str)


# 9 -- substring dedup


def brute_removals(rows, min_words):
    """Every unit's occurrence but the earliest."""
    first, every = {}, set()
    for doc, text in sorted({(r[0], r[1]) for r in rows if r[1]}, key=lambda x: (x[0] is None, x[0])):
        for a, b, words in substring_lines.units(text, min_words):
            every.add((doc, a, b, words))
            first.setdefault(words, (doc, a))
    return {(d, a, b) for d, a, b, w in every if first[w] != (d, a)}


def test_removals(docs, none):
    got = substring_lines.removals(docs, 6).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in got} == brute_removals(ROWS, 6)
    for r in got:
        mine = TEXT[r["doc_id"]][r["start"] : r["end"]]
        words = substring_lines.WORDS.findall(mine.lower())
        rest = substring_lines.WORDS.findall(TEXT[r["first_doc"]][r["first_start"] :].lower())
        assert rest[: len(words)] == words
    assert substring_lines.removals(none).collect() == []


def plain_words(text):
    """Words by a scan of the letters."""
    out, word = [], ""
    for c in text.lower() + " ":
        solo = any(a <= ord(c) <= b for a, b in substring_lines.SOLO)
        if c.isalnum() and not solo:
            word += c
            continue
        out += [w for w in (word, c if solo and c.isalnum() else "") if w]
        word = ""
    return out


def plain_units(text, min_words):
    """Lines and the sentences inside them, for texts too short for runs."""
    out, at = set(), 0
    for line in re.findall(r"[^\n]+\n*|\n+", text):
        cuts, start, k = [], 0, 0
        body = line.rstrip("\n")
        while k < len(body):
            k += 1
            if body[k - 1] not in ".!?。！？":
                continue
            tail = k
            while tail < len(body) and body[tail] in ".!?。！？":
                tail += 1
            white = tail
            while white < len(body) and body[white].isspace():
                white += 1
            if white > tail or set(body[k - 1 : tail]) & set("。！？") or tail == len(body):
                cuts.append(white)
                tail = white
            k = tail
        pieces, part = [], 0
        for end in [*cuts, len(line)]:
            # an end counts once enough words stand since the one before
            if end == len(line) or len(plain_words(line[start:end])) >= substring_lines.SENTENCE_WORDS:
                pieces.append((part, end))
                part = end
            start = end
        whole = plain_words(line)
        if len(whole) >= min_words:
            out.add((at, at + len(line), " ".join(whole)))
        for a, b in pieces:
            words = plain_words(line[a:b])
            if min_words <= len(words) < len(whole):
                out.add((at + a, at + b, " ".join(words)))
        at += len(line)
    return out


def test_units_are_lines_and_sentences():
    import random

    text = "One. Two. Three four five six seven eight! 3.14 is pi, they say so here. \n\nNext line of six words follows\nshort"
    found = [text[a:b] for a, b, _ in substring_lines.units(text, 5)]
    line = text.split("\n")[0] + "\n\n"
    assert found == [line, "One. Two. Three four five six seven eight! ", "3.14 is pi, they say so here. ", "Next line of six words follows\n"]
    assert [w for *_, w in substring_lines.units("漢字かな。", 1)] == ["漢 字 か な"]
    assert substring_lines.units("", 1) == [] and substring_lines.units("\n\n", 1) == []
    rnd = random.Random(5)
    letters = ["one", "Two", "x1", "é", "漢", "字", "。", ".", "!", "?", " ", " ", " ", " ", "\n", "_", ",", "ไ"]
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))
        if len(plain_words(text)) < substring_lines.RUN_WORDS + substring_lines.WINDOW - 1:
            for least in (1, 3, 6):
                got = substring_lines.units(text, least)
                assert len(got) == len(set(got)) and set(got) == plain_units(text, least), (text, least)


def test_short_lines_stay(spark):
    """A line of fewer than twenty words that documents share stays unless fewer words are asked for; a longer one goes."""
    stock = "licensed under terms that every document of this source repeats"
    passage = " ".join(f"word{k}" for k in range(20))
    rows = [(k, f"{stock}\nown{k} words{k}\n{passage}", "en", "s", 1) for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = {r["doc_id"]: r["text"] for r in substring_lines.dedup(docs).collect()}
    assert all(stock in t and (passage in t) == (k == 0) for k, t in left.items()) and len(left) == 3
    left = {r["doc_id"]: r["text"] for r in substring_lines.dedup(docs, 6).collect()}
    assert all((stock in t) == (passage in t) == (k == 0) for k, t in left.items()) and len(left) == 3


def test_dedup(wide, none, docs):
    got = substring_lines.dedup(wide, 6, drop_emptied=False)
    assert got.schema == wide.schema
    cuts = defaultdict(list)
    for d, a, b in brute_removals(ROWS, 6):
        cuts[d].append((a, b))
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = TEXT[r["doc_id"]]
        want = substring_lines.cut_spans(text, cuts[r["doc_id"]]) if text else text
        assert r["text"] == want
        assert r["n_chars"] == (None if want is None else len(want))
    kept = {r["doc_id"] for r in substring_lines.dedup(docs, 6).collect()}
    gone = set(TEXT) - kept
    assert gone and all(not substring_lines.WORDS.search(substring_lines.cut_spans(TEXT[d], cuts[d])) for d in gone)
    assert substring_lines.dedup(none).collect() == []


def test_null_ids_rank_last(spark):
    line = "the very same line of many words stands here"
    rows = [(None, line, "en", "s", 1), (7, line, "en", "s", 1), (3, line, "en", "s", 1)]
    got = substring_lines.removals(spark.createDataFrame(rows, SCHEMA), 6).collect()
    assert sorted((str(r["doc_id"]), r["first_doc"]) for r in got) == [("7", 3), ("None", 3)]


def longest_shared(texts, least):
    """The longest run of ``least`` words or more that two of the texts have (0: none)."""
    lists = [substring_lines.WORDS.findall((t or "").lower()) for t in texts]
    n = least
    while True:
        home, shared = {}, False
        for k, w in enumerate(lists):
            for i in range(len(w) - n + 1):
                shared |= home.setdefault(tuple(w[i : i + n]), k) != k
        if not shared:
            return 0 if n == least else n - 1
        n += 1


def test_runs_inside_sentences(spark):
    """Passages that start and end inside long sentences, cross short lines or repeat themselves leave no run of over 50 words."""
    import random

    rnd = random.Random(8)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    shared = [fresh(51), fresh(60), fresh(90), fresh(300), fresh(29) * 8, fresh(23) * 9, fresh(4) * 40, fresh(1) * 120]
    texts = []
    for passage in shared:
        for k in range(3):
            gap = "\n" if k == 1 else " "
            texts.append(" ".join(fresh(13 + k)) + " " + gap.join(passage) + " " + " ".join(fresh(17 - k)))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    assert longest_shared(texts, 51) >= 300
    got = {r["doc_id"]: r["text"] for r in substring_lines.dedup(docs).collect()}
    assert longest_shared(got.values(), 51) == 0
    for k, passage in enumerate(shared):
        own = texts[3 * k].split()
        left = got[3 * k].split()
        # the first copy stays, of a passage that repeats itself its first 30 words at least
        assert left == own if k < 4 else left[: 13 + 30] == own[: 13 + 30]
    for k, t in enumerate(texts):  # what only one document has stays
        assert set(t.split()[:13]) | set(t.split()[-15:]) <= set(got[k].split())
    chars = {r["doc_id"]: r["removed_chars"] for r in substring_lines.report(docs).collect()}
    assert all(chars.get(k, 0) == len(t) - len(got[k]) for k, t in enumerate(texts))


def test_documents_by_id_and_text(spark):
    """Rows without an id, or with the same one, but with other texts are not cut at each other's offsets."""
    line = "the very same line of many words stands here"
    other = "quite another line that only this text has here"
    texts = {
        (None, f"{line}\nfirst own words"): 2,
        (None, f"{line}\nsecond own words"): 1,
        (None, f"{other} and it goes on for a while after that"): 1,
        (5, f"{line}\nthird own words"): 1,
        (5, f"{other.replace('quite', 'yet')}\nfourth own words"): 2,
    }
    rows = [(d, t, "en", "s", len(t)) for (d, t), n in texts.items() for _ in range(n)]
    got = sorted((str(r["doc_id"]), r["text"]) for r in substring_lines.dedup(spark.createDataFrame(rows, SCHEMA), 6).collect())
    want = [(str(d), t if d or line not in t else t.split("\n")[1]) for d, t, *_ in rows]
    assert got == sorted(want)
    # without any id
    rows = [(None, t, "en", "s", len(t)) for t in (f"{line}\nfirst own words", f"{line}\nsecond own words")]
    got = [r["text"] for r in substring_lines.dedup(spark.createDataFrame(rows, SCHEMA), 6).collect()]
    assert sum(line in t for t in got) == 1 and all("own words" in t for t in got)


# 10 -- personal data


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in spans[k])


def test_personal_data(docs, none):
    got = pii_weak.find(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        spans = base_spans(TEXT[r["doc_id"]])
        assert r["base"] == joined(spans)
        assert [r[f"n_{k}"] for k in spans] == [len(s) for s in spans.values()]
        assert r["spans"].startswith(r["base"])
        assert (r["n_secret"] > 0) == ("secret:" in r["spans"])
    assert pii_weak.find(none).collect() == []


def test_random_personal_data(spark):
    """Spans equal those of the stated patterns on adversarial strings."""
    import random

    rnd = random.Random(11)
    bits = ["a", "b1", "@", ".", "-", "_", "+", "1", "12", "255", "256", "4111111111111111", " ", "(", ")", "\n", "é", "🙂", "x.y", "@q.w", "+1234567", "1.2.3.4", "\x01", "\x04"]
    rows = [(k, "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))), "en", "s", 0) for k in range(3000)]
    model = pii_weak.SpanModel(0.5, [], -1.0, {n: [0.0] * k for n, (k, _) in pii_weak.FEATURES.items()})
    got = pii_weak.find(spark.createDataFrame(rows, SCHEMA), model).collect()
    wrong = [(rows[r["doc_id"]][1], r["base"]) for r in got if r["base"] != joined(base_spans(rows[r["doc_id"]][1]))]
    assert wrong == []


def test_many_spans(spark):
    """Positions stay right beyond one chunk of parts."""
    text = " ".join(f"u{k}@h{k}.org" for k in range(1300))
    got = pii_weak.find(spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)).collect()[0]
    assert got["base"] == joined(base_spans(text))


def test_secrets_learned(spark):
    import random

    rnd = random.Random(2)
    rows, secret = [], set()
    for k in range(200):
        if k % 4 == 0:
            value = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
            rows.append((k, f'some words token = "{value}" and more', "en", "s", 0))
            secret.add(k)
        else:
            rows.append((k, f"invoice {rnd.randint(10**13, 10**14)} of the year", "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = pii_weak.train(docs)
    assert 0.15 < model.share < 0.35
    assert all(p > 0.6 > 0.4 > q for p, q in model.rates)
    got = pii_weak.find(docs, model).collect()
    assert {r["doc_id"] for r in got if r["n_secret"]} == secret


def test_mask(wide):
    rows = pii_weak.mask(wide)
    assert rows.columns == wide.columns
    model_rows = by_id(pii_weak.find(wide))
    for r in rows.collect():
        text = TEXT[r["doc_id"]]
        spans = sorted((int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in model_rows[r["doc_id"]]["spans"].split(",") if s)
        out, at, last = "", 0, -1
        for a, b, kind in spans:
            if a >= last:
                out += text[at:a] + f"[{kind.upper()}]"
            last = max(last, b)
            at = last
        want = text if not spans else out + text[at:]
        assert r["text"] == want and r["n_chars"] == (None if text is None else len(want))
