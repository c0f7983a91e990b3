"""Periodic runs, conversation repair and document fingerprints against brute-force versions."""
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barflow.llm import fingerprints, periodic, repair

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, runs string, kept string, _h int, part int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- periodic runs

def brute_runs(ws, min_words=24, min_turns=3):
    n, out = len(ws), []
    for q in range(1, n // min_turns + 1):
        i = 0
        while i < n - q:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(min_words, min_turns * q) and not any(all(ws[k] == ws[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def test_runs_of_random_words():
    rng = random.Random(5)
    texts = []
    for k in range(300):
        ws = []
        while len(ws) < rng.randint(0, 160):
            root = [rng.choice("abc"[:rng.randint(1, 3)] if k % 2 else "abcdefghijklmnopq") for _ in range(rng.randint(1, 14))]
            ws += root * rng.choice([1, 1, 3, 5, 9]) + root[:rng.randint(0, len(root))]
        texts.append([w.encode() for w in ws])
    texts += [[], [b"a"] * 23, [b"a"] * 24, [b"a"] * 5000, [b"a", b"b"] * 12, [], [b"a"] * 30 + [b"x"] + [b"a"] * 30]
    for small in ((24, 3), (6, 3), (9, 4)):
        got = [[tuple(map(int, r)) for r in rows] for rows in periodic.runs_of(texts, *small)]
        want = [brute_runs(t, *small) if len(t) < 1000 else [(0, len(t), 1)] for t in texts]
        assert got == want
    assert sum(map(len, want)) > 300


def test_frequency_splitting_keeps_what_recurs():
    ws = "x a b a b a b rare a b a b q a a a q".split()
    codes, ends = periodic.numbered([[w.encode() for w in ws]])
    at, name, end = periodic.survivors(codes, ends, 3, 3)
    assert at.tolist() == [1, 2, 3, 4, 5, 6, 13, 14, 15] and end.tolist() == [7] * 6 + [16] * 3       # the middle part falls in a second round
    assert len(set(name[:6].tolist())) == 2


def brute_planted(doc_id, text):
    ws = WORD.findall(text or "")
    n = len(ws)
    if doc_id is None:
        return ws
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    return ws


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["aa", "bb", "cc", "dé", "ee ", "f\t", " g"]) for _ in range(r.randint(0, 90))) + r.choice(["", "\n"])) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n\x0b"), (203, "one"), (204, "la " * 3000), (None, "la " * 40), (None, None), (5, "la " * 40), (5, "la " * 40),
             (-7, "w1 w2 w3 " * 20), (206, " ".join(f"w{k % 1500}" for k in range(6000))), (207, "x" * 100_000)]
    return spark.createDataFrame([(i, t, "r", "k", 1, 2) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_periodic_runs(spark, docs, empty, tmp_path):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(docs).collect())
    want = Counter()
    known = {204: [(0, 3000, 1)], 206: [(0, 6000, 1500)]}
    for i, t in rows:
        ws = WORD.findall(t or "")
        runs = known.get(i) or brute_runs(ws)
        want[i, len(ws), tuple(runs), brute_collapse(ws, runs)] += 1
    assert got == want
    assert periodic.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, min_turns=2)


@pytest.mark.parametrize("own", [True, False])
def test_op11(spark, docs, tmp_path, own):
    sf = SF
    if own:
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        sf = str(tmp_path)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = Counter()
    for i, t in rows:
        ws = brute_planted(i, t)
        if len(ws) > 2000 and len(set(ws)) < 3:
            runs = [(0, len(ws), 1)]
        elif i == 206 and own:
            runs = [(0, 6000, 1500)]
        else:
            runs = [tuple(map(int, r)) for r in periodic.runs_of([[w.encode() for w in ws]])[0]] if len(ws) > 600 else brute_runs(ws)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        want[i, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(brute_collapse(ws, runs))] += 1
    got = Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
                  for r in periodic.op11_periodic_runs(spark, sf).collect())
    assert got == want and sum(r[1] > 0 for r in want) > 5


# ---------------------------------------------------------------- conversation repair

TURNS = "conv_id long, turn long, role string, text string, pos string, sha int, cost int"


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        show = lambda v: " " if v is None else str(v)     # noqa: E731
        kind = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """Whole strings in one forward pass: for each state the least (cost, audit), and what stands then."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    seen, faults = set(), Counter()
    best = {"": (0, "", [])}

    def inserted(best):
        todo = dict(best)
        for _ in range(2):
            for s, (c, a, ls) in list(todo.items()):
                q = "a" if s == "u" else "u"
                new = (c + 5, a + "I", [*ls, ("user" if q == "u" else "assistant") + ":"])
                todo[q] = min(todo.get(q, new), new, key=lambda x: x[:2])
        return todo

    for _, role, text in rows:
        words = WORD.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        new = {}

        def put(s, c, a, ls):
            if s not in new or (c, a) < new[s][:2]:
                new[s] = (c, a, ls)

        # inserts may follow each other in any number, so all of them are kept apart by state
        ways = [(s, v) for s, v in best.items()]
        for s, v in list(ways):
            for n in (1, 2):
                s, v = ("a" if s == "u" else "u"), (v[0] + 5, v[1] + "I", [*v[2], ("assistant" if s == "u" else "user") + ":"])
                ways.append((s, v))
        for s, (c, a, ls) in ways:
            put(s, c + 2, a + "D", ls)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                i, due = role[:1], "a" if s == "u" else "u"
                if i == due or i == "s" and s == "":
                    put(i, c + more, a + "K", [*ls, f"{role}:{text}"])
                put(due, c + more + 1, a + "R", [*ls, ("assistant" if s == "u" else "user") + ":" + text])
        best = new
    c, a, ls = min((v for s, v in inserted(best).items() if s in ("", "a")), key=lambda x: x[:2])
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, c, a, sha("\n".join(ls))


@pytest.fixture(scope="module")
def turns(spark):
    r, rows = random.Random(3), []
    says = ["Hi.", "Why?", "no end", "", " \t", None, "Yes!", "So be it. ", "line\nline."]
    for c in range(120):
        for t in range(r.choice([0, 1, 2, 5, 9, 30])):
            rows.append((c, t if r.random() < 0.9 else r.choice([None, 3, 77]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]),
                         r.choice(says) if r.random() < 0.7 else f"Text {r.randint(0, 99)}."))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (500, None, None, None), (501, 0, "user", "x " * 50_000 + "."), (501, 1, "assistant", "y")]
    rows += [(502, t // 2, ["user", "assistant"][t % 3 == 1], f"{t}." if t % 7 else f"{t}") for t in range(700)] + [(503, 0, "user", "Same.")] * 40
    return spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], TURNS).repartition(4)


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_repair(spark, turns, block):
    by = defaultdict(list)
    for r in turns.collect():
        by[r.conv_id].append((r.turn, " " if r.role is None else r.role, " " if r.text is None else r.text))
    rows = repair.repair(turns, block)
    got = {r[0]: tuple(r[1:]) for r in repair.summary(rows).collect()}
    assert got == {c: brute_repair(x) for c, x in by.items()}
    made = defaultdict(list)
    for r in rows.orderBy("pos").collect():
        made[r.conv_id] += [x.role[0] for x in r.lines]
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in made.values())


def test_op12(spark, turns, tmp_path):
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    for sf in (SF, str(tmp_path)):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        by = {r[0]: [] for r in rows}
        for r in brute_damage(rows):
            by[r[0]].append(r[1:])
        got = [tuple(r) for r in repair.op12_conversation_repair(spark, sf).collect()]
        assert Counter(got) == Counter((c, *brute_repair(x)) for c, x in by.items())


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.repair(none).count() == 0 and repair.summary(repair.repair(none)).count() == 0
    assert repair.all_conversations(repair.summary(repair.repair(none)), none).count() == 0


def test_crossings_are_least():
    """All edit strings of short conversations, by trying every one."""
    r = random.Random(1)
    for _ in range(60):
        classes = [r.randrange(16) for _ in range(r.randint(1, 4))]
        options = [[(p, q, *repair.ROWS[c][p][q]) for p in range(4) for q in range(4) if repair.ROWS[c][p][q][0] < repair.FAR] for c in classes]
        best = None
        for way in itertools.product(*options):
            if way[0][0] == 0 and all(x[1] == y[0] for x, y in zip(way, way[1:])):
                end = repair.END[way[-1][1]]
                mine = sum(x[2] for x in way) + 5 * end, "".join(x[3] for x in way) + "I" * end
                best = min(best or mine, mine)
        states = repair.crossings([*(repair.ELEMENTS[c] for c in classes), repair.CLOSE], 0, 0)
        cells = [repair.ROWS[c][p][q] for c, p, q in zip(classes, [0, *states], states)]
        end = repair.END[states[-2]]
        assert (sum(c for c, _ in cells) + 5 * end, "".join(e for _, e in cells) + "I" * end) == best


# ---------------------------------------------------------------- fingerprints

def shingles(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_bins_one_by_one():
    """Binning and densification as plain loops."""
    texts = [b"one", b"a b c d e f g h", b" ".join(b"w%d" % (i % 700) for i in range(900)), b"", b"A b"]
    hashes, ends = fingerprints.shingle_hashes(texts)
    assert np.diff(ends).tolist() == [1, 4, 896, 0, 1]
    bins = 64
    low, some = fingerprints.low_bits(texts, bins, 3)
    for k in range(len(texts)):
        least = {}
        for h in map(int, hashes[ends[k]:ends[k + 1]]):
            b = h >> 58
            least[b] = min(least.get(b, h), h)
        assert some[k] == bool(least)
        for b in range(bins) if least else []:
            seed, t, at = int(fingerprints.mixed(np.array([b], np.uint64) * fingerprints._GAMMA + np.uint64(1))[0]), 0, b
            while at not in least:
                t += 1
                at = int(fingerprints.mixed(np.array([(seed + t * int(fingerprints._GAMMA)) % 2**64], np.uint64))[0]) % bins
            own = fingerprints.mixed(np.array([(least[at] + b * int(fingerprints._GAMMA)) % 2**64], np.uint64))[0]
            assert low[k][b] == int(own) % 8
    back = fingerprints.unpacked(fingerprints.packed_bits(low, some, 3), bins, 3)
    assert (back[0][some] == low[some]).all() and (back[1] == some).all()


def test_likeness_follows_the_sets():
    r = random.Random(4)
    off = []
    for _ in range(60):
        base, new = ([f"w{r.randrange(10**6)}" for _ in range(r.choice([60, 400, 3000]))] for _ in range(2))
        cut = r.randint(0, len(base))
        a, b = " ".join(base), " ".join(base[:cut] + new[cut:])
        low, some = fingerprints.low_bits([a.encode(), b.encode()])
        est = fingerprints.likeness((low[:1], some[:1]), (low[1:], some[1:]))[0]
        off.append(est - jaccard(a, b))
    assert abs(np.mean(off)) < 0.015 and np.sqrt(np.mean(np.square(off))) < 0.04


def test_fingerprints(spark, docs, empty):
    got = defaultdict(set)
    for r in fingerprints.fingerprints(docs, 128, 4).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        got[r.text].add(bytes(r.fingerprint))
    assert {len(x) for t, v in got.items() for x in v} == {0, 64}
    assert fingerprints.fingerprints(empty).count() == 0
    assert fingerprints.fingerprints(docs).count() == docs.count()
    with pytest.raises(ValueError):
        fingerprints.fingerprints(docs, 100)


@pytest.mark.parametrize("own", [True, False])
def test_op13(spark, docs, tmp_path, own):
    sf = SF
    if own:
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        sf = str(tmp_path)
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = fingerprints.op13_fingerprints(spark, sf).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for i, t in rows:
        by[i].append(t)
    ids = sorted((i for i in by if i is not None), reverse=True) + [None] * (None in by)
    after = {i: by[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}
    for r in got:
        texts, follow = by[r.doc_id], after[r.doc_id] + (by[r.doc_id] if len(by[r.doc_id]) > 1 else [])
        fits = [(t, u, fingerprints.edited(t, u)) for t in texts for u in follow if len(t) == r.n_chars and sha(fingerprints.edited(t, u)) == r.edited_sha256]
        assert fits
        t, u, e = fits[0]
        own_print = fingerprints.packed_bits(*fingerprints.low_bits([t.encode(), e.encode()]))
        assert [r.fingerprint, r.edited_fingerprint] == [x.hex() for x in own_print]
        assert abs(r.near_edited - jaccard(t, e)) < 0.2 and min(abs(r.near_next - jaccard(t, v)) for v in follow) < 0.2
    same = defaultdict(set)
    for r in got:
        if len(by[r.doc_id]) == 1:
            same[by[r.doc_id][0]].add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_one_document_and_none(spark, empty):
    assert fingerprints.neighbours(empty).count() == 0
    one = fingerprints.neighbours(spark.createDataFrame([(1, "a b c d e f g", "", "", 1, 2)], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].n_chars == 13
