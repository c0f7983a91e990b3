"""Operators of barflow.llm against brute-force versions, on small tables with every awkward row."""
import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm import bpe, bytebpe, counts, exact, near, packing, quality, templates, toxicity, transcripts, urls
from barflow.plans.check import compare, duck

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, _row int, _key int"
JSON = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = prose(7, 30_000)
TEXTS = [
    (1, "Hello world, it's a test\n\nHello  world, it's\ta test"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, "one"), (6, "one"), (7, "One  two"),
    (8, LONG), (9, LONG + " end"), (10, "l’été ½ ٣ 漢字 \U0001f600\U0001f468‍\U0001f469 \x1c\x85\u00a0x"), (11, "<|endoftext|>a<|endoftext|><|endof text|>"),
    (12, "x" * 70_000), (13, "\u0558\ua7ce \U0003d000a1"), (14, "same " * 300), (15, "Hello world, it's a test\n\nHello world, it's a test"),
    (15, "Hello world, it's a test\n\nHello world, it's a test"), (None, "one"), (None, None), (16, "a b c d e f"), (17, "a b c d e f g"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["s1", "s2", None][k % 3], 0, "clash", 1, 2) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_line_templates", "op3_minhash_near_dedup", "op4_exact_dedup", "op10_url_filter"])
def test_against_sql(spark, name):
    from barflow.llm.catalog import ORACLES, QUERIES
    ok, note = compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name])
    assert ok, note


def brute_quality(text):
    ws = WORD.findall(text or "")
    at = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if at[tuple(ws[i:i + 3])] > 1 for k in range(3)}
    ls = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(covered)


def test_quality(docs, empty):
    got = quality.rated(docs).collect()
    want = Counter((i, *brute_quality(t)) for i, t in TEXTS)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality.rated(empty).count() == 0
    kept = quality.passing(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_ablation(docs):
    rows = quality.ledger(docs)
    got = {(r.policy, r.rule): r for r in quality.ablation(rows, [quality.BASE, quality.DEFAULT]).collect()}
    bits = [r.fail_bits for r in rows.collect()]
    for policy in (quality.BASE, quality.DEFAULT):
        for rule in policy.rules:
            bit = quality.Policy("", (rule,)).mask
            r = got[policy.version, rule]
            assert r.n_failed == sum(b & bit > 0 for b in bits) and r.n_only == sum(b & policy.mask == bit for b in bits)
            assert r.n_passed == sum(b & policy.mask == 0 for b in bits)


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return Counter((i, smallest[norm(t)], len(groups[norm(t)]), i == smallest[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


def test_exact(docs, empty):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, exact.dedup(docs).select(*cols).collect())) == brute_exact(TEXTS)
    # a digest that unlike texts share: the bytes decide
    weak = exact.dedup(docs, digest=lambda body: F.length(body).cast("string"))
    assert Counter(map(tuple, weak.select(*cols).collect())) == brute_exact(TEXTS)
    assert exact.dedup(empty).count() == 0
    left = exact.deduplicated(docs)
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect())) == [1, 2, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 16, 17]


def test_exact_goes_on(spark, docs, tmp_path):
    state, rows = str(tmp_path / "state"), [(i, t) for i, t in TEXTS if i is not None]
    part = lambda ids: docs.where(F.col("doc_id").isin(ids))
    exact.dedup(part([5, 7]), state=state).collect()
    got = exact.dedup(part([1, 6, 15]), state=state).where("doc_id = 6").collect()[0]
    assert (got.keep_id, got.group_size, got.kept) == (5, 2, False) and rows


def test_exact_goes_on_with_unlike_texts_of_one_digest(spark, tmp_path):
    """Hits on rows of earlier calls are compared with their bytes, and texts that share a digest are grouped apart over all calls."""
    weak = lambda body: F.length(body).cast("string")
    calls = [[(5, "abc"), (8, "long text"), (9, "abc")], [(6, "xyz"), (7, "abc"), (20, "long text")], [(1, "xyz"), (2, "uvw"), (30, "uvw"), (31, "abc"), (40, None)]]
    seen = []
    for k, rows in enumerate(calls):
        got = exact.dedup(spark.createDataFrame(rows, "doc_id long, text string"), weak, str(tmp_path / "state")).collect()
        seen += rows
        want = {(i, keep, n, kept, digest) for i, keep, n, kept, digest in brute_exact(seen) if i in {x for x, _ in rows}}
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(rows), k


def brute_near(rows, width=5, percent=85):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for _, t in rows:
        ws = WORD.findall((t or "").translate(low))
        sets.append({tuple(ws[k:k + width]) for k in range(max(1, len(ws) - width + 1))} if ws else set())
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and ids[x] is not None and ids[y] is not None and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(ids[x]), root(ids[y])))
                parent[b] = a
    return Counter((i, len(s), root(i), i is None or root(i) == i) for i, s in zip(ids, sets))


def mutated(base: list[str], seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(prose(seed * 1000 + k, 1) if r.random() < share else w for k, w in enumerate(base))


@pytest.mark.parametrize("block", [2048, 7])
def test_near(spark, docs, empty, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)       # buckets in one block, and split
    rows = [(i, t) for i, t in TEXTS if i != 12]
    for g, n in ((0, 150), (1, 60), (2, 2500)):
        base = prose(100 + g, n).split()
        rows += [(100 + 40 * g + k, mutated(base, 50 * g + k, 0.012 * k)) for k in range(25)]
        rows.append((90 + g, prose(100 + g, n).upper()))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_shingles int").repartition(4)
    assert Counter(map(tuple, near.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())) == brute_near(rows)
    if block == 7:
        assert near.near_duplicates(empty).count() == 0
        assert near.one_of_each(df).columns == df.columns


def test_sketches_hold_their_bounds():
    r = np.random.default_rng(1)
    common, gaps = r.integers(0, 2**63, 2000).astype(np.uint64), []
    for k in (10, 60, 160, 400):
        a, b = (np.unique(np.concatenate([common, r.integers(0, 2**63, k).astype(np.uint64)])) for _ in range(2))
        jaccard = 2000 / (2000 + 2 * k)
        bits = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y))
        assert bits(near.set_bitmap(a), near.set_bitmap(b)) <= 2 * k
        differ = bits(near.odd_sketch(near.min_hashes(a)), near.odd_sketch(near.min_hashes(b)))
        gaps.append(abs(near.odd_estimate(differ) - jaccard))
        assert jaccard < 0.85 or differ <= near.most_differing(85)
    assert max(gaps) < 0.15
    k, p = near.ROWS * near.BANDS, 0.15
    worst = near.most_differing(85) // 2
    assert sum(math.comb(k, i) * p**i * (1 - p)**(k - i) for i in range(worst + 1, k + 1)) < 1e-8


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("chunk, overlap", [(32_768, 512), (200, 24), (100, 40)])
def test_token_counts(docs, empty, library, chunk, overlap):
    got = counts.token_counts(docs, JSON, P.PATTERN, chunk=chunk, overlap=overlap)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert got.where("over_limit <> (n_tokens > 1024)").count() == 0 and counts.token_counts(empty, JSON, P.PATTERN).count() == 0


def test_repeated_huge_rows_are_counted_one_by_one(spark, library):
    """Equal ids and sizes, one text that finds no common cut and one that does."""
    texts = ["x" * 7_000, ("abcdefg hij " * 600)[:7_000], "x" * 7_000, "é" * 3_500]
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    got = counts.token_counts(docs, JSON, P.PATTERN, chunk=400, overlap=40).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter((1, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)


def test_pieces_are_the_librarys(library):
    c = bpe.Coder(JSON, P.PATTERN)
    odd = "".join(f"a{chr(x)}1{chr(x)} {chr(x)}!{chr(x)}" for x in [*range(0x250), *range(0x2000, 0x2100), *range(0x3000, 0x3100), *range(0x1F600, 0x1F640)])
    for text in [odd, *(t or "" for _, t in TEXTS if t is not LONG)]:
        assert c.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


class IdsOnly:
    """A library that gives ids, and not the pieces they belong to."""

    def __init__(self, library):
        self.encode_batch_fast = library.encode_batch_fast


def test_new_pieces_are_told_apart_by_the_widths_of_their_tokens():
    c, plain = bpe.Coder(JSON, P.PATTERN), bpe.Coder(JSON, P.PATTERN)
    texts = ["Été à Zürich, 12 500 €  and\n\n more", "naïve 😀😀 \u3000x\x00y", "<|endoftext|> a<|endoftext|>b", "", " "] + [f"w{i}ñ {i * i}" for i in range(3000)]
    slow = [[plain.one_piece.encode([p], is_pretokenized=True, add_special_tokens=False).ids if p not in c.added else [c.added[p]] for p in plain.pieces(t)] for t in texts]
    c.one_piece = IdsOnly(c.one_piece)
    assert [c.counts(c.pieces(t)).tolist() for t in texts] == [list(map(len, x)) for x in slow]
    assert [c.encode(t).tolist() for t in texts] == [[i for x in y for i in x] for y in slow]


def test_pieces_with_bytes_that_have_no_token():
    import json
    d = json.loads(JSON)
    lost = {d["model"]["vocab"].pop("q")}
    d["model"]["merges"] = [m for m in d["model"]["merges"] if "q" not in "".join(m)]
    d["model"]["vocab"] = {k: v for k, v in d["model"]["vocab"].items() if "q" not in k or v in lost}
    c = bpe.Coder(json.dumps(d), P.PATTERN)
    assert [len(c.encode(t)) for t in ("aq b", "qq", "b")] == [len(c.library.encode(t, add_special_tokens=False).ids) for t in ("aq b", "qq", "b")]


def test_coder_forgets(monkeypatch, library):
    monkeypatch.setattr(bpe, "MAX_PIECES", 50)
    c = bpe.Coder(JSON, P.PATTERN)
    for k in range(12):
        text = prose(k % 3, 600)
        assert c.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bytes_both_ways(docs, empty):
    import tiktoken
    definition = bpe.ranks_to_json(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = docs.where("doc_id <> 12 OR doc_id IS NULL")
    there = bytebpe.encode(some, definition, P.PATTERN)
    text_of = {i: t or "" for i, t in TEXTS}
    for r in bytebpe.decode(there, definition).collect():
        if r.doc_id is None:
            continue
        text = text_of[r.doc_id]
        assert r.ids == other.encode_ordinary(text) and bytes(r.bytes) == text.encode() and r.text == text
        at = 0
        for i, s in zip(r.ids[:2000], r.starts[:2000]):
            assert s == len(text.encode()[:at].decode(errors="ignore")) or text.encode()[at] & 0xC0 == 0x80
            at += len(other.decode_single_token_bytes(i))
    assert bytebpe.encode(empty, definition, P.PATTERN).count() == 0
    # digests of the round trip, row by row
    digest = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    want = Counter((r.doc_id, len(r.ids), digest(r.ids), digest(r.starts)) for r in there.collect())
    trip = bytebpe.round_trip(some, definition, P.PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.starts_sha256) for r in trip) == want
    assert all(r.decoded_sha256 == hashlib.sha256(text_of[r.doc_id].encode()).hexdigest() for r in trip if r.doc_id is not None)
    assert bytebpe.round_trip(empty, definition, P.PATTERN).count() == 0
    # ids cut inside a character
    cut = some.sparkSession.createDataFrame([(other.encode_ordinary("漢\U0001f600")[:2],), (None,)], "ids array<int>")
    half = bytebpe.decode(cut, definition).collect()
    assert half[0].text.endswith("\ufffd") and half[1].text is None


@pytest.mark.parametrize("targets, quantum", [(None, 128), ({"s1": 3.0, "s2": 1.0}, 64)])
def test_packing(docs, empty, library, targets, quantum):
    got = packing.pack(docs, JSON, P.PATTERN, targets=targets, quantum=quantum).collect()
    ids = {}
    for i, t in TEXTS:
        ids.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [0])
    pieces = {}
    for r in got:
        assert any(r.doc_tokens == len(x) and zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert pieces == {i: sum(map(len, x)) for i, x in ids.items()}
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, s in spans.items():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 1024 or k == max(spans)
    assert sorted(spans) == list(range(len(spans))) and packing.pack(empty, JSON, P.PATTERN).count() == 0


def test_packing_of_many_sources(spark, library, monkeypatch):
    """Sources without a queue of their own keep their shares too, level by level of the tree."""
    monkeypatch.setattr(packing, "FAN", 4)
    rows = [(i, prose(i, 30 + i % 50), f"s{i % 60}" if i % 61 else None) for i in range(900)] + [(900, LONG, "s59"), (901, "", "s7")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = packing.pack(df, JSON, P.PATTERN, quantum=16, max_queues=4).collect()
    ids = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t, _ in rows}
    at, met = 0, Counter()
    source_of, totals = {i: s for i, _, s in rows}, Counter()
    for i, x in ids.items():
        totals[source_of[i]] += len(x)
    whole, seen = sum(totals.values()), {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 1024 + r.offset == at and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        at += r.length
        met[source_of[r.doc_id]] += r.length
        assert all(abs(met[s] - at * n / whole) <= 2 * 16 * 5 for s, n in totals.items())
    for i, x in ids.items():
        end = 0
        for start, length in sorted(seen[i]):
            assert start == end
            end += length
        assert end == len(x)


def test_packing_by_many_targets(docs, spark):
    targets = {f"s{k}": 1.0 + k % 3 for k in range(100)}
    got = packing.pack(docs, JSON, P.PATTERN, targets=targets)
    assert got.agg({"length": "sum"}).first()[0] == packing.pack(docs, JSON, P.PATTERN).agg({"length": "sum"}).first()[0]


def test_order_is_deficit_round_robin():
    totals, weights, quantum = [1000, 370, 64, 0], [5, 3, 1, 1], 10
    served, turns = [0] * 4, []
    while any(s * quantum < t for s, t in zip(served, totals)):         # always the queue whose next credit time comes first
        q = min((q for q in range(4) if served[q] * quantum < totals[q]), key=lambda q: ((2 * served[q] + 1) / weights[q], q))
        turns.append((q, served[q]))
        served[q] += 1
    order, at = packing.Order(totals, weights, quantum), 0
    for q, j in turns:
        assert order.positions(q, np.array([j]))[0] == at
        at += min(quantum, totals[q] - j * quantum)


def brute_templates(rows, depth, min_words, min_docs):
    def leaf(x):
        ws = ["<*>" if re.search("[0-9]", w) else w for w in WORD.findall(x)]
        return (len(ws), *(ws[:depth] if len(ws) <= 2 * depth else ws)) if len(ws) >= min_words else None
    met, first = Counter(), {}
    for i, t in rows:
        for k in {leaf(x) for x in (t or "").split("\n")} - {None}:
            met[k] += 1
            first[k] = i if first.get(k) is None or i is not None and i < first[k] else first[k]
    out = Counter()
    for i, t in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if not (met[leaf(x)] >= min_docs and first[leaf(x)] != i)]
        out[i, "\n".join(stay), len(ls), len(ls) - len(stay)] += 1
    return out


def test_templates(spark, docs, empty):
    rows = [r for r in TEXTS if r[0] not in (8, 9, 12)] + [(100 + k, f"Request {k} took {k * 7} ms at host-{k}\nown {prose(k, 6)}\nshort\n{prose(1, 20)}") for k in range(9)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, leaf string")
    got = templates.drop_templates(df, min_docs=4)
    assert Counter(map(tuple, got.collect())) == brute_templates(rows, templates.DEPTH, templates.MIN_WORDS, 4)
    assert templates.drop_templates(empty).count() == 0


def test_short_and_literal_lines(spark):
    """Short lines drop at three documents here, long literal ones at two; what stays apart in one word stays."""
    long = prose(2, 12)
    rows = [(k, f"All rights reserved.\n\nPage {k}\n{prose(50 + k, 6)}") for k in range(3)] + [(10, f"{long}\nTwice here"), (11, f"Twice here\n{long}"), (12, long + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in templates.drop_templates(df, short_docs=3, literal_docs=2).collect()}
    assert [got[k].n_dropped for k in (0, 1, 2, 10, 11, 12)] == [0, 1, 1, 0, 1, 0]
    assert got[1].text == f"\nPage 1\n{prose(51, 6)}" and got[11].text == "Twice here"


def test_toxicity(spark, empty):
    r = random.Random(3)
    bad, ids, rows, labels = ["scumoid", "idiotas", "moronic"], range(600), [], []
    for i in ids:
        ws, toxic = prose(i, r.randint(20, 120)).split(), i % 4 == 0
        for _ in range(r.randint(2, 9) if toxic else 0):
            ws.insert(r.randrange(len(ws)), r.choice(bad))
        rows.append((i, " ".join(ws), 5))
        labels.append((i, 1, int(toxic), "x"))
    rows += [(1000, None, 5), (1001, "", 5), (1002, "?!", 5), (None, "idiotas moronic scumoid", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1, 1, "x"), (5, 0, None, "x")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.fit(df, known, per_class=150)
    got = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    held_out = [(got[i].kept, i % 4 == 0) for i in ids if i % 3 == 0]
    assert sum(kept != toxic for kept, toxic in held_out) / len(held_out) > 0.97
    assert all(got[i].kept and got[i].severity == 0 for i in (1000, 1001)) and not got[None].kept
    assert (np.diff(model.thresholds) > 0).all()
    grades = [np.mean([got[i].severity for i in ids if i % 4 == 0 and lo <= sum(b in (rows[i][1]) for b in bad) <= hi]) for lo, hi in ((0, 1), (3, 3))]
    assert grades[0] < grades[1]
    left = toxicity.accepted(df, model)
    assert left.columns == df.columns and Counter(x.doc_id for x in left.collect()) == Counter(x.doc_id for x in got.values() if x.kept)
    none = toxicity.fit(df, known.limit(0))
    assert none is None and toxicity.score(df, none).where("NOT kept").count() == 0
    assert toxicity.score(empty, model).count() == 0


def plain_viterbi(chain, features):
    e = chain.lines(features)
    v, back = chain.start + e[0], []
    for x in e[1:]:
        all_ = v[:, None] + chain.step
        back.append(all_.argmax(0))
        v = all_.max(0) + x
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_transcripts(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    lines = transcripts.transcribed(turns)
    chain = transcripts.fit(transcripts.featured(lines, 64))
    whole = {tuple(r[:3]): r for r in transcripts.parse(lines).collect()}
    assert whole == {tuple(r[:3]): r for r in transcripts.parse(lines, chain, block=1).collect()}
    truth = {(r.conv_id, r.turn, r.line): r.role for r in lines.collect()}
    assert sum(whole[k].role == v for k, v in truth.items()) / len(truth) > 0.9
    by = {}
    for r in transcripts.featured(lines, 64).orderBy("conv_id", "turn", "line").collect():
        by.setdefault(r.conv_id, []).append(r)
    for conv, rows in by.items():
        path = plain_viterbi(chain, np.array([(r.marker, r.length, r.asks) for r in rows]))
        assert [transcripts.ROLES[s // 2] for s in path] == [whole[conv, r.turn, r.line].role for r in rows]
        text = "".join(whole[conv, r.turn, r.line].rendered for r in rows)
        assert text.startswith("<|") and text.endswith("\n<|end|>") and text.count("<|end|>") == sum(whole[conv, r.turn, r.line].starts for r in rows)


def test_transcripts_of_awkward_rows(spark):
    shape = "conv_id long, turn long, role string, text string, block int"
    rows = [(1, 0, "user", "Hi\n\nthere?", 1), (1, 1, None, None, 1), (1, 2, "robot", "", 1), (None, 0, "user", "alone", 1), (1, None, "system", "rules", 1),
            (2, 0, "user", "same", 1), (2, 0, "user", "same", 1)]
    df = transcripts.transcribed(spark.createDataFrame(rows, shape))
    assert transcripts.parse(df, block=2).count() == df.count() == 9
    assert transcripts.parse(transcripts.transcribed(spark.createDataFrame([], shape))).count() == 0


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"(/[^?#]*)?", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(h.count(".") + 1, len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls(spark):
    urls_ = [None, "", "no scheme", "://", "http://", "http://COM/", "http://com", "https://a.Example.com/en/x?y#z", "https://www.example.com/en/", "http://b.www.example.com/en",
             "http://x.net/es/1", "http://net/fr/", "http://notnet/fr/", "http://u@x.net:80/fr/", "ftp://x.net?/es/", "a://b://c.com/", "http://éÉ.com/\n/x", "http://x.net//es/"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls_ + urls_[5:7])], "page_id long, url string, host string, rule string")
    rules = [*urls.RULES, ("block", "x.com", "/ab"), ("allow", "x.com", "/ab/c")]
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(df, rules).collect()}
    assert got == {i: brute_rule(u, rules) for i, u in enumerate(urls_ + urls_[5:7])}
    trie = urls.Trie(rules)
    assert trie.longest("x.com", "/abc")[1] == "x.com/ab" and trie.longest("x.com", "/ab/c/d")[0] == "allow"
    assert urls.judge(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        urls.judge(df, [("allow", "com", "/")] * (urls.MAX_RULES + 1))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C
    sf = str(tmp_path)
    base = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10_000 + k, t, "en", None, None) for k, t in enumerate([None, "", LONG, LONG, LONG + " tail"])]
    base.unionByName(spark.createDataFrame(extra, base.schema)).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in C.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.schema.names == before.schema.names
            docs.write.parquet(f"{sf}/{name}.parquet")
            docs = spark.read.parquet(f"{sf}/{name}.parquet")
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen["quality_rules"][0], spark.read.parquet(f"{sf}/quality_rules.parquet")
    assert set(ids(after)) <= {i for i, t in rows(before) if brute_quality(t)[0] >= 50} and len(ids(after)) > 0.5 * before.count()
    after4 = spark.read.parquet(f"{sf}/exact_dedup.parquet")
    assert ids(after4) == sorted(k[0] for k in brute_exact(rows(after)) if k[3])
    after3 = spark.read.parquet(f"{sf}/near_dedup.parquet")
    assert ids(after3) == sorted(k[0] for k in brute_near(rows(after4), percent=C.NEAR_PERCENT) if k[3])
    packed = Counter(r.doc_id for r in seen["packing"][1].select("doc_id").distinct().collect())
    assert packed == Counter(ids(after3))
    assert Counter(map(tuple, C.run(spark, sf).select("doc_id", "start", "length", "sequence_id").collect())).total() > 0
