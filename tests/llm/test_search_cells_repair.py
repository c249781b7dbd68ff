"""Lexical search, vector cells and conversation repair against brute force, with nulls, ties, repeats and no rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ridgewater.llm import cell_cosine, derivation_repair, signature_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CASE = {c: c + 32 for c in range(65, 91)}


# 11
def brute_search(docs, items, k=10):
    counts = [(i, Counter(TERM.findall((t or "").translate(CASE)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        terms = {t for t in TERM.findall((text or "").translate(CASE)) if df[t]}
        found = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, math.inf if i is None else i))
        for rank, (score, i) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if i == math.inf else i, -score))
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def search_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)] + ["Ünï", "a1", "中文"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", "-", ", "]).join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 60, 300])))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(7, docs[7][1])] * 15 + [(None, docs[9][1]), (None, docs[9][1] + " w3"), (5000, None), (5001, ""), (5002, " .,;")]
    docs += [(6000, " ".join(f"x{i}" for i in range(30_000)) + " w90 w90"), (8, "w1 other text of one id W1")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 12])))) for i in range(30)]
    items += [(0, "w110 w111"), (None, "W3 w7"), (90, None), (91, ""), (92, "unknown words"), (93, docs[7][1]), (94, "ünï ÜNÏ w0 x17")]
    return docs, items


@pytest.mark.parametrize("batch", [200_000, 40])
def test_search_equals_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(signature_search, "BATCH_TERMS", batch)
    docs, items = search_rows()
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, key string, id string").repartition(5)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, q int, row int").repartition(2)
    got = [tuple(r) for r in signature_search.search(table, asked).collect()]
    assert key(got) == key(brute_search(docs, items))


def test_search_bounds_hold_and_are_used(spark):
    """No bound is below its score, and most documents are excluded without being read again."""
    rng = random.Random(9)
    docs = [(i, " ".join(f"t{int(rng.paretovariate(0.6))}" for _ in range(80))) for i in range(2000)]
    items = [(i, docs[i * 50][1][:60]) for i in range(8)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = signature_search.signatures(table)
    assert index.selectExpr("sum(size(ids))").first()[0] == 2000
    scores = defaultdict(int)
    for item, _, i, score in brute_search(docs, items, 2000):
        scores[item, i] = score
    counts = Counter(t for _, t in docs for t in set(TERM.findall(t)))
    query_terms = [sorted({t for t in TERM.findall(text) if t in counts}) for _, text in items]
    data = [t.encode() for x in query_terms for t in x]
    ends = np.cumsum([len(t) for t in data])
    hashes = signature_search._hashes(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    weights = np.array([math.floor(1000 * math.log((2 * 2000 + 2) / (2 * counts[t] + 1))) for x in query_terms for t in x], float)
    query = signature_search.Query(hashes, weights, np.cumsum([0] + [len(x) for x in query_terms]), 2000, 2000 * 80)
    close = 0
    for row in index.collect():
        most = signature_search.bounds(row["rows"], bytes(row.bits), np.array(row.sizes), query)
        for q in range(len(items)):
            for column, i in enumerate(row.ids):
                assert most[q, column] >= scores[q, i]
                close += most[q, column] <= 1.25 * scores[q, i] + 1
    assert close > 0.8 * 2000 * len(items)
    least = np.array([sorted((s for (q, _), s in scores.items() if q == item), reverse=True)[9] for item in range(8)], float)
    assert signature_search.candidates(index, query, least, np.full(8, 2**62)).count() < 8 * 200


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert signature_search.search(docs, items).collect() == []
    assert signature_search.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []


# 12
def brute_links(rows, like=0.98):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / max(map(abs, v))
        return v / np.sqrt((v * v).sum())

    made = [unit(v) for _, v, _ in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and made[i] is not None and made[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2]
             and len(made[i]) == len(made[j]) and float(made[i] @ made[j]) >= like] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, front = {i}, [i]
        while front:
            front = [k for j in front for k in near[j] if k not in group]
            group |= set(front)
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            out[j] = (rows[j][0], len(near[j]), min(ids, default=None), not ids or rows[j][0] == min(ids))
    return out


def vector_rows(seed=3, dim=6):
    rng = np.random.default_rng(seed)
    rows = []
    for centre in rng.normal(size=(12, dim)):
        for _ in range(25):
            rows.append((centre + rng.normal(size=dim) * 0.12).tolist())
    rows += rng.normal(size=(80, dim)).tolist()
    rows = [(i, v, int(rng.integers(3))) for i, v in enumerate(rows)]
    nan, inf = math.nan, math.inf
    rows += [(900 + i, rows[4][1], rows[4][2]) for i in range(30)] + [rows[5]] * 3
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * dim, 1), (2003, [1.0] * (dim - 1) + [nan], 1), (2004, [inf] + [1.0] * (dim - 1), 1)]
    rows += [(2005, [None] + [1.0] * (dim - 1), 1), (2006, rows[0][1], None), (2007, rows[0][1], None), (2008, [1e-200] * dim, 2), (2009, [1e200] * dim, 2)]
    rows += [(2010, [1.0, 1.0], 2), (2011, [1.0, 1.01], 2), (None, rows[1][1], rows[1][2]), (None, [9.0] + [0.5] * (dim - 1), 0), (None, [9.0] + [0.5] * (dim - 1), 0)]
    rows += [(2012, [-0.0] + [1.0] * (dim - 1), 2), (2013, [0.0] + [1.0] * (dim - 1), 2)]
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_cells_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(cell_cosine, "EACH", 12)
    monkeypatch.setattr(cell_cosine.linked_in_blocks, "__defaults__", (cell_cosine.LIKE, block))
    rows = vector_rows()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n int, id string").repartition(4)
    got = [tuple(r) for r in cell_cosine.near_duplicates(table).collect()]
    assert key(got) == key(brute_links(rows))


def test_cells_spread_and_visit(spark):
    rows = [(i, v, 0) for i, v, _ in vector_rows(8) if v and len(v) == 6 and all(x is not None and math.isfinite(x) and x for x in v) and i is not None and i < 400]
    table = spark.createDataFrame(rows, "class long, vector array<double>, label int").selectExpr("label", "size(vector) length", "vector", "1L n", "class")
    made = cell_cosine.centres(table, 12)
    assert made.shape == (12, 6) and np.allclose((made * made).sum(axis=1), 1)
    placed = cell_cosine.in_cells(table, made).collect()
    homes = [r for r in placed if r.cell == r.home]
    assert len(homes) == len(rows) < len(placed) < 12 * len(rows) and len({r.home for r in homes}) == 12
    assert all(r.cell in r.visits for r in placed)


def test_cells_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert cell_cosine.near_duplicates(none).collect() == []
    same = spark.createDataFrame([(i, [1.0, 0.0], 1) for i in range(5)] + [(9, [0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert key(tuple(r) for r in cell_cosine.near_duplicates(same).collect()) == [(i, 4, 0, i == 0) for i in range(5)] + [(9, 0, 9, True)]


# 13
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        order = (turn is not None, turn or 0, role, text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        if kind:
            out[conv] += [(order, turn, role, text)] * (2 if kind == 3 else 1)
    return {c: [r[1:] for r in sorted(x, key=lambda r: r[0])] for c, x in out.items()}


def brute_repair(rows):
    """Every sequence of edits, shortest prefixes first, kept only where it could still be least: no agenda, no segments."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(3):
            more = dict(best)
            for state, (cost, audit, lines) in best.items():
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (state, x) in step:
                        new = (cost + 3, audit + "I", (*lines, f"{name}:"))
                        more[step[state, x]] = min(more.get(step[state, x], new), new)
            best = more
        return best

    best = inserted(best)
    for (_, role, text), fault in zip(rows, faults):
        more = {}
        for state, (cost, audit, lines) in best.items():
            options = [("D", 4, state, ())]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if (state, role[:1]) in step:
                    options.append(("K", extra, step[state, role[:1]], (f"{role}:{text}",)))
                options += [("R", 3 + extra, step[state, x], (f"{name}:{text}",)) for x, name in (("u", "user"), ("a", "assistant")) if (state, x) in step]
            for letter, more_cost, to, line in options:
                new = (cost + more_cost, audit + letter, (*lines, *line))
                more[to] = min(more.get(to, new), new)
        best = inserted(more)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(lines)),
    )


def conversation_rows():
    rng, out = random.Random(11), []
    texts = ["Fine.", "Why?", "no end", "  ", "", None, "Ends! ", "a\nb.", "Ünï.", "x?"]
    for conv in range(150):
        for turn in range(rng.randrange(8)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "s", "Agent"])
            out.append((conv, rng.choice([turn, turn, turn, turn * 3, None, 2]), role, rng.choice(texts)))
    out += [(500, t, ("user", "assistant")[t % 2] if rng.random() > 0.1 else "system", rng.choice(["Well.", "cut", f"Say {t}."])) for t in range(400)]
    out += [(None, t, "user", "Hello.") for t in (1, None, 3)] + [(600, 1, "user", "Same."), (600, 1, "user", "Same."), (600, 1, "assistant", "Same.")]
    out += [(601, -(2**63), "user", "a."), (601, 2**63 - 1, "assistant", "b.")]
    return out


@pytest.mark.parametrize("bits,fan", [(9, 16), (3, 2)])
def test_repair_equals_brute_force(spark, monkeypatch, bits, fan):
    monkeypatch.setattr(derivation_repair, "SEGMENT_BITS", bits)
    monkeypatch.setattr(derivation_repair, "FAN", fan)
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, place int").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in derivation_repair.repaired(table).collect()}
    wanted = {c: brute_repair(r) for c, r in brute_damage(rows).items()}
    assert got[601][0] is None or got[601] == wanted[601]
    got.pop(601), wanted.pop(601)
    assert got == wanted


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert derivation_repair.repaired(none).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(1, dropped, "user", "Hi.")], none.schema)
    assert [tuple(r) for r in derivation_repair.repaired(one).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_agenda_takes_the_lightest_hyperedge():
    edges = [((), 2, "b", "x"), ((), 1, "c", "y"), (("x", "y"), 1, "d", "z"), (("x",), 2, "a", "z"), (("z", "z"), 0, "", "w"), ((), 9, "", "w")]
    assert derivation_repair.lightest(edges, {"z", "w", "none"}) == {"z": (4, "ba"), "w": (8, "baba")}
