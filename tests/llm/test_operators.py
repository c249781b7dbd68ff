"""Each operator against brute force on texts with every awkward case, on no rows and on repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgewater.llm import automata, cotraining, exact_dedup, licences, minhash_dedup, mixing, packing, parsing, pseudonyms, repeats, syncmers
from ridgewater.llm.registry import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(rows):
    return {r[0]: r[1] or "" for r in rows}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# 1
def test_pseudonyms_keep_formats_and_reverse(docs, rows):
    made = {r.doc_id: r for r in pseudonyms.pseudonymised(docs, "k").collect()}
    before, after = texts(rows)[32], made[32].text
    assert (made[32].n_card, made[32].n_number, made[32].n_phone, made[32].n_ip, made[32].n_date, made[32].n_email) == (1, 1, 1, 1, 2, 1)
    for gone in ("555-7713", "4929 3483", "4111111111111111", "10.0.0.1", "2024-02-29", "03/04/2021", "a.b1@"):
        assert gone in before and gone not in after
    assert "300.1.1.1" in after and "31.02.2020" in after and "@mail.example.com" in after
    card = re.search(r"(?<!\d)\d{16}(?!\d)", after).group()
    assert sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, card))) % 10 == 0
    assert all(made[i].text == r[1] for i, r in ((r[0], r) for r in rows) if i not in (32,))
    back = pseudonyms.pseudonymised(pseudonyms.pseudonymised(docs, "k"), "k", back=True)
    assert {r.doc_id: r.text for r in back.collect()} == {r[0]: r[1] for r in rows}


def test_pseudonyms_are_permutations(spark):
    days = spark.range(0, pseudonyms.CYCLE, 1, 4).select(pseudonyms.permute_number(F.col("id"), 189, 773, "k", "date").alias("x"))
    assert days.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first() == (pseudonyms.CYCLE, 0, pseudonyms.CYCLE - 1)
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    assert digits.select(pseudonyms.permute_text(F.col("t"), "k", "x").alias("y")).distinct().count() == 1000


# 2
@pytest.mark.parametrize("layout", ["d/m/y", "y-mm-d", "y-m-dd", "dd.mm.y", "mm/dd/y", "m/dd/y"])
def test_dates_of_each_layout_are_permuted(spark, layout):
    """All dates of 400 years in one layout: different, readable in the same way, reversible."""
    day = F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int"))
    month, dom = F.month(day), F.dayofmonth(day)
    wide = {"y": F.lpad(F.year(day).cast("string"), 4, "0"), "m": month.cast("string"), "d": dom.cast("string")}
    wide |= {"mm": F.lpad(wide["m"], 2, "0"), "dd": F.lpad(wide["d"], 2, "0")}
    mark = re.search("[-/.]", layout).group()
    fields = layout.split(mark)
    written = F.concat_ws(mark, *[wide[f] for f in fields])
    fits = F.lit(True)
    for f, value in (("m", month), ("d", dom)):
        fits = fits & (value < 10) if f in fields else fits
    fits = fits & (dom > 12) if fields[0][0] == "m" else fits
    df = spark.range(0, pseudonyms.CYCLE, 1, 8).filter(fits).select(written.alias("v"), F.lit("date").alias("kind"))
    made = df.withColumn("w", pseudonyms.pseudonym(F.col("v"), F.col("kind"), "k"))
    got = made.withColumn("back", pseudonyms.pseudonym(F.col("w"), F.col("kind"), "k", back=True)).toPandas()
    assert (got.back == got.v).all() and set(got.w) == set(got.v) and (got.w == got.v).mean() < 0.01


def test_phones_link_whatever_their_separators(spark):
    numbers = ["+49 30 1234567", "+49301234567", "+49-30-123-4567", "+353 1 234 5678", "+35312345678", "+1 (415) 555-2671", "+14155552671", "+7 495 123 45 67"]
    df = spark.createDataFrame([(i, f"call {n}.") for i, n in enumerate(numbers)], "doc_id long, text string")
    made = [r.text for r in pseudonyms.pseudonymised(df, "k").orderBy("doc_id").collect()]
    digits = [re.sub("[^0-9]", "", t) for t in made]
    assert digits[0] == digits[1] == digits[2] and digits[3] == digits[4] and digits[5] == digits[6] and len(set(digits)) == 4
    assert [d[: len(c)] for d, c in zip(digits, "49 49 49 353 353 1 1 7".split())] == "49 49 49 353 353 1 1 7".split()
    assert all(re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", f"call {b}.") and b not in a for a, b in zip(made, numbers))
    back = pseudonyms.pseudonymised(pseudonyms.pseudonymised(df, "k"), "k", back=True).orderBy("doc_id").collect()
    assert [r.text for r in back] == [f"call {n}." for n in numbers]


def test_mixing_takes_what_targets_say(docs, rows):
    found, draws = mixing.mix_sources(docs, block_words=50, shard_words=500)
    taken = {r["row"]: r for r in draws.groupBy("row").agg(F.sum("words").alias("t"), F.max("copy").alias("c")).collect()}
    found = found.collect()
    sizes = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    assert {r["id"]: r["size"] for r in found} == sizes
    sources = {r[0]: r[3] for r in rows}
    total = Counter()
    for i, n in sizes.items():
        total[sources[i]] += n
    ordered = sorted((s for s in total if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(ordered)}
    target, free, left = {}, set(ordered), float(sum(total.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    by_source = Counter()
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == total[r["source"]]
        t = taken[r["row"]]["t"] if r["row"] in taken else 0
        assert t <= 3 * r["size"]
        by_source[r["source"]] += t
    assert all(abs(by_source[s] - target[s]) <= 0.5 for s in ordered)
    spread = draws.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("p"), F.max("position").alias("m")).collect()
    assert len(spread) > 5 and all(s.n == s.p == s.m for s in spread)


def test_splitting_tree_is_exact(spark):
    quotas = {0: 700, 1: 31, 2: 5}
    parts = mixing.shard_quotas(spark, quotas, 37, seed=3, group=4).collect()
    shards = Counter()
    for rank, q in quotas.items():
        spans = sorted((p.start, p.n) for p in parts if p["rank"] == rank)
        assert sum(n for _, n in spans) == q and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    for p in parts:
        shards[p.shard] += p.n
    assert set(shards.values()) <= {736 // 37, 736 // 37 + 1}
    assert sorted(parts) == sorted(mixing.shard_quotas(spark, quotas, 37, seed=3, group=64).collect())


def test_mixed_documents_repeat_whole_texts(docs, rows):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    own = texts(rows)
    for r in out.collect():
        assert r.text == own[r.doc_id] or own[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)


def test_mixed_documents_keep_null_and_repeated_ids(spark):
    """Every source is drawn in whole passes but for one cut document: 3, 3 and the rest of all words."""
    rows = [(None if i % 3 == 0 else 1 if i % 3 == 1 else i, f"r{i} " + "w " * 19, f"s{i % 2}", 40 + i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    found, draws = mixing.mix_sources(docs)
    target = {r.source: r.target for r in found.select("source", "target").distinct().collect()}
    out = mixing.mixed_documents(docs).collect()
    words, times, cut = Counter(), Counter(), Counter()
    own = {r[1].split()[0]: r for r in rows}
    for r in out:
        first = r.text.split()[0]
        assert (r.doc_id, r.source) == (own[first][0], own[first][2]) and own[first][1].startswith(r.text)
        words[r.source] += len(WORD.findall(r.text))
        times[first] += 1
        cut[r.source] += len(WORD.findall(r.text)) < 20
    assert {s: abs(words[s] - t) <= 0.5 for s, t in target.items()} == {s: True for s in target}
    assert len(out) == draws.count() and max(cut.values()) <= 1
    for s in target:
        counts = [times[k] for k, r in own.items() if r[2] == s]
        assert max(counts) - min(counts) <= 1


# 3
def test_fingerprints_of_edited_texts(docs, rows):
    got = {r.id: r for r in syncmers.edited_fingerprints(docs).collect()}
    own = texts(rows)
    order = sorted(own, reverse=True)
    for i, doc in enumerate(order):
        text, following = own[doc], own[order[(i + 1) % len(order)]]
        half = len(text) // 2
        assert got[doc].edited_sha256 == sha(text[: len(text) - half] + following[:half]) and got[doc].n_chars == len(text)
    assert got[7].fingerprint == got[3].fingerprint != got[5].fingerprint and got[22].fingerprint == got[23].fingerprint == ""
    assert 0.1 < got[29].near_edited < 0.6 and got[29].near_next == 0.0 and len(got[29].fingerprint) == 64 * 8


def test_anchors_are_closed_syncmers(spark):
    words = "d a c b e a f".split()
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    for k, s in ((3, 1), (5, 2)):
        inner = [r[0] for r in df.select(F.explode(F.array(*[F.xxhash64(*([F.xxhash64(F.lit(w)) for w in words[i : i + s]] if s > 1 else [])) if s > 1 else F.xxhash64(F.lit(words[i])) for i in range(len(words) - s + 1)]))).collect()]
        if s == 1:
            wanted = sum(min(inner[i], inner[i + k - s]) == min(inner[i : i + k - s + 1]) for i in range(len(words) - k + 1))
            found = syncmers.with_anchors(df, "text", "a", k, s).first()["a"]
            assert len(found) == wanted and found == sorted(found)
        else:
            assert 1 <= len(syncmers.with_anchors(df, "text", "a", k, s).first()["a"]) <= 3


# 4
def brute_components(rows, like=0.85):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts(rows).items():
        w = WORD.findall(t.translate(lower))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= round(100 * like) * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return sets, root


def test_near_duplicates(docs, rows, monkeypatch):
    sets, root = brute_components(rows)
    got = {r.id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == root
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == root[i]) for i, r in got.items())
    assert got[5].component_id == 3 and not got[5].kept


def test_chain_of_near_copies_in_blocks(spark, monkeypatch):
    """Neighbours are linked, the ends are not; tiny blocks make every comparison cross between groups."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(24):
        words = list(base)
        for j in range(i):
            words[16 * j] = f"x{j}"
        rows.append((i, " ".join(words)))
    _, root = brute_components(rows)
    crossing = minhash_dedup._crossing
    monkeypatch.setattr(minhash_dedup, "_crossing", lambda m, p: crossing(m, p, 5))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.component_id for r in got} == root


def test_bands_and_margin_follow_from_similarity():
    assert minhash_dedup.plan(0.85)[:2] == (24, 60) and minhash_dedup.plan(0.8)[:2] == (35, 88)
    for like in (0.5, 0.8, 0.85, 0.95):
        made = minhash_dedup.plan(like)
        assert (1 - like**5) ** made.bands <= 1e-6 < (1 - like**5) ** (made.bands - 1)
        ends = made.parts() % made.functions
        assert all(len(set(band)) == 5 for band in ends.tolist()) and made.parts().max() < 2 * made.functions
        draws = np.random.default_rng(5).binomial(760, like, 200_000)
        assert (draws < made.agree).sum() <= 3 and (draws < made.agree + 30).sum() > 3


# 5
def test_licences_and_inheritance(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [
        (1, "a/LICENSE", apache + "\nmore words that follow the statement here and there and anywhere"), (2, "a/b/c/x", "no statement"),
        (3, "a/b/COPYING.txt", mit), (4, "a/b/c/d/y", None), (5, "a/z", "code\n" + mit.lower()), (6, "q/z", ""), (7, None, apache),
        (8, "a/q", "a licence to thrill is no statement"), (9, "e/f", "text " * 30 + "\n" + apache), (10, "e/g", "x"), (10, "e/g", "x"),
    ]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id", F.col("path")).collect()
    found = {r.id: (r.licence, r.licence_from) for r in got}
    assert len(got) == len(rows) and found == {
        1: ("Apache-2.0", "a/LICENSE"), 2: ("MIT", "a/b"), 3: ("MIT", "a/b/COPYING.txt"), 4: ("MIT", "a/b"), 5: ("MIT", "a/z"),
        6: (None, None), 7: ("Apache-2.0", None), 8: ("Apache-2.0", "a"), 9: ("Apache-2.0", "e/f"), 10: (None, None),
    }


@pytest.mark.parametrize("times", [1, 50])
def test_licences_do_not_depend_on_size(spark, times):
    lines = ["All rights reserved."] * 4 + ["Licensed under CC BY-NC 4.0.", "Released under the MIT License."] * 8
    df = spark.createDataFrame([(i, f"d{i}/x", x) for i, x in enumerate(lines * 10 * times)], "doc_id long, path string, text string")
    got = licences.scan(df, "doc_id", F.col("path")).groupBy("own_licence").count().collect()
    assert {r[0]: r[1] for r in got} == {"Proprietary": 40 * times, "CC-BY-NC-4.0": 80 * times, "MIT": 80 * times}


def test_licences_of_headers_and_whole_texts(spark):
    texts = dict(licences.licence_texts())
    rows = [(f"whole/{name}/x", name, f"Copyright 2021 Some One\n\n{text}") for name, text in texts.items()]
    for name, text in licences.NOTICES + [(n, texts[n]) for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")]:
        code = "\n\n" + "\n".join(f"call_{i}(value_{i * 7}, other)" for i in range(300))
        lines = text.replace(". ", ".\n").splitlines()
        rows.append((f"hash/{name}/x", name, "\n".join(["#!/bin/sh", *(f"# {x}".rstrip() for x in lines)]) + code))
        rows.append((f"star/{name}/x", name, "/*\n" + "\n".join(lines) + "\n*/" + code))
    rows.append(("none/x", None, "The free software of the day\n\n" + "plain prose about rivers and the law of the sea " * 100))
    df = spark.createDataFrame([(p, t) for p, _, t in rows], "path string, text string")
    got = {r.path: (r.own_licence, r.is_licence_file) for r in licences.scan(df, "path", F.col("path")).collect()}
    assert got == {p: (name, p.startswith("whole")) for p, name, _ in rows}


# 6
def brute_words(rows, length=20):
    seen, out = set(), {}
    for i, t in sorted(texts(rows).items()):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            passage = tuple(w[s : s + length])
            if passage in seen:
                gone[s : s + length] = [True] * length
            seen.add(passage)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("hot", [(5_000, 20_000), (1_000, 2), (2, 20_000)])
def test_repeated_word_passages(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_ANCHOR", hot[0])
    monkeypatch.setattr(repeats, "HOT_HOME", hot[1])
    got = automata.without_repeats(docs).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(rows)


def test_automaton_on_small_alphabet():
    rng = np.random.default_rng(0)
    for case in range(60):
        shard, seen = automata.Automaton(), set()
        for _ in range(4):
            words = [bytes([97 + int(c)]) for c in rng.integers(0, 2 + case % 3, 30)]
            wanted = np.zeros(30, bool)
            for s in range(27):
                if tuple(words[s : s + 4]) in seen:
                    wanted[s : s + 4] = True
                seen.add(tuple(words[s : s + 4]))
            found = np.zeros(30, bool)
            for a, b in shard.stream(words, 4):
                found[a:b] = True
            assert (found == wanted).all()


# 7
def test_cotraining_learns_and_keeps_clean(spark):
    def row(i):
        bad = i % 4 == 0
        words = [f"{'BUY' if bad else 'word'}{(i * 7 + j) % 50}{'!!' if bad else ''}" for j in range(30)]
        return (i, " ".join(words), "en", f"s{i % 5}", 150, None if i % 3 == 1 else int(not bad))

    df = spark.createDataFrame([row(i) for i in range(600)] + [(None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, quality int")
    model = cotraining.train(df.drop("quality"), df.select("doc_id", "quality"), rounds=1)
    got = cotraining.scored(df, model).collect()
    judged = [(r["__score"] >= 0.5) == (r.doc_id % 4 != 0) for r in got if r.doc_id is not None]
    assert len(got) == 601 and sum(judged) / len(judged) > 0.99
    assert cotraining.keep_good(df.limit(0), df.select("doc_id", "quality")).count() == 0
    one = cotraining.train(df, df.select("doc_id", F.lit(1).alias("quality")))
    assert one.constant == 1.0
    few = df.select("doc_id", F.when(F.col("doc_id") == 4, 0).when(F.col("doc_id").isin(1, 2, 3, 5), 1).alias("quality"))
    assert cotraining.train(df.drop("quality"), few, rounds=1).constant is None


def test_cotraining_hands_over_from_all_documents(spark):
    """The surest come from exact quantiles over every document, rare sources too, and samples are drawn from all of them."""
    n = 4000
    odds = spark.createDataFrame([(i, 20.0 * (i % 997) / 997 - 10, 8.0 - i * 16 / n) for i in range(n)], "id long, text_view double, meta_view double")
    cuts = cotraining.surest(odds, 0.75, 0.2)
    for view, at in (("text_view", 1), ("meta_view", 2)):
        values = [r[at] for r in odds.collect()]
        want = np.quantile(values, [0.2 * 0.25, 1 - 0.2 * 0.75])
        assert np.allclose(cuts[view], [min(want[0], -math.log(19)), max(want[1], math.log(19))])
    every = cotraining.handed_over(odds, cuts, 0.75, 10**9, 1).collect()
    sure = {"meta_view": [r.id for r in odds.collect() if not cuts["text_view"][0] < r.text_view < cuts["text_view"][1]]}
    assert sorted(r.id for r in every if r.view == "meta_view") == sorted(sure["meta_view"])
    some = cotraining.handed_over(odds, cuts, 0.75, 200, 1).filter("view = 'meta_view'").collect()
    assert 120 < len(some) < 280 and max(r.id for r in some) > n * 0.9 and min(r.id for r in some) < n * 0.1


# 8
def brute_bytes(rows, length=200):
    counts = Counter(b[s : s + length] for b in (t.encode() for t in texts(rows).values()) for s in range(len(b) - length + 1))
    out = {}
    for i, t in texts(rows).items():
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if counts[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


@pytest.mark.parametrize("hot", [(5_000, 20_000), (1_000, 2), (2, 20_000)])
def test_repeated_byte_strings(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_ANCHOR", hot[0])
    monkeypatch.setattr(repeats, "HOT_HOME", hot[1])
    got = parsing.without_repeats(docs).collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(rows)


def test_corpus_order_is_lexicographic():
    rng = np.random.default_rng(1)
    for case in range(20):
        pieces = [rng.integers(97, 99 + case % 3, n).astype(np.uint8) for n in (300, 40, 500, 9)]
        pieces.append(pieces[0][50:280])
        data, bounds = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        order = parsing.corpus_order(data, bounds, 20)
        raw = data.tobytes()
        cut = [raw[i : i + 20] for i in order.tolist()]
        assert cut == sorted(cut) and len(cut) == sum(max(0, len(p) - 19) for p in pieces)


# 9
def test_packing_places_every_token_once(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    own = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in texts(rows).items()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, tokenizer_path(), pool=4).collect():
        assert r.ids_crc32 == zlib.crc32(own[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(own[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for doc, ids in own.items():
        spans = sorted(pieces[doc])
        assert spans[0][0] == 0 and sum(n for _, n in spans) == len(ids) and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and sum(spans[-1]) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_differencing_balances():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 60, 300).tolist()
    totals, items = packing.differencing(sizes, 8)
    assert sorted(i for w in items for i in w) == list(range(300)) and totals[-1] - totals[0] <= 8
    assert [sum(sizes[i] for i in w) for w in items] == totals.tolist()
    assert len(packing.balanced([600, 600, 600], 1000)) == 3


# 10
def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in texts(rows).items():
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t)].append((-len(t), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], sha(t)) for t, g in groups.items() for _, i in g}


@pytest.mark.parametrize("counters", [1, 2, 1023])
def test_exact_groups(docs, rows, counters):
    got = exact_dedup.exact_groups(docs, counters=counters).collect()
    assert {r.id: (r.keep_id, r.group_size, r.kept, r.digest) for r in got} == brute_groups(rows)
    assert {r.doc_id for r in exact_dedup.keep_one(docs).collect()} == {i for i, g in brute_groups(rows).items() if g[2]}


def test_frequent_values_are_never_missed(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, "warm").otherwise(F.col("id").cast("string")).alias("v")).repartition(7)
    found = {r.value: r.at_least for r in exact_dedup.frequent(df, 15).collect()}
    assert len(found) <= 15 and found["hot"] <= 1000 and {"hot", "warm"} <= set(found)


# all
def test_no_rows(nothing):
    found, draws = mixing.mix_sources(nothing)
    frames = [
        pseudonyms.pseudonymised(nothing, "k"), found, draws, mixing.mixed_documents(nothing), syncmers.edited_fingerprints(nothing),
        minhash_dedup.near_duplicates(nothing), licences.scan(nothing, "doc_id", F.col("source")), automata.without_repeats(nothing),
        parsing.without_repeats(nothing), packing.pack(nothing, tokenizer_path()), exact_dedup.exact_groups(nothing), exact_dedup.keep_one(nothing),
    ]
    assert all(f.count() == 0 for f in frames)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, text, None), (None, None, None)], "doc_id long, text string, source string")
    assert sum(r.kept for r in exact_dedup.exact_groups(df).collect()) == 2 and exact_dedup.keep_one(df).count() == 2
    near = minhash_dedup.near_duplicates(df).collect()
    assert len(near) == 4 and {r.component_id for r in near if r.id == 1} == {1}
    words = automata.without_repeats(df).collect()
    assert sorted((r.id or 0, r.n_removed) for r in words if r.n_words) == [(0, 0), (1, 60), (1, 60)]
    assert len(syncmers.edited_fingerprints(df).collect()) == 4 and packing.pack(df, tokenizer_path()).count() >= 4
    found, draws = mixing.mix_sources(df)
    assert found.count() == 4 and parsing.without_repeats(df).count() == 4


@pytest.mark.parametrize("hot", [(20_000, 20_000), (3, 20_000), (1_000, 3)])
def test_repeats_between_texts_of_one_id(spark, hot, monkeypatch):
    """Different texts of one id or of none are documents of their own, in the order of a hash."""
    monkeypatch.setattr(repeats, "HOT_ANCHOR", hot[0])
    monkeypatch.setattr(repeats, "HOT_HOME", hot[1])
    shared, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"o{i}" for i in range(40))
    found = [(1, shared), (2, other), (2, f"x y z {shared}"), (2, f"x y z {shared}"), (None, f"a b {other}"), (None, f"c d e {other}"), (None, None)]
    found += [(3, "tick tock " * 300), (4, "tick tock " * 200), (3, "tock " + "tick tock " * 100)]
    df = spark.createDataFrame(found, "doc_id long, text string")
    hashed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("part"))
    order = sorted({(r.doc_id or 0, r.part, r.text) for r in hashed.collect()})
    numbered = {(i, t): n for n, (i, _, t) in enumerate(order)}
    for operator, brute in ((automata, brute_words), (parsing, brute_bytes)):
        want = brute([(n, t) for (_, t), n in numbered.items()])
        got = [(r[0] or 0, *r[1:]) for r in operator.without_repeats(df).collect()]
        assert sorted(got) == sorted((i or 0, *want[numbered[i or 0, t or ""]]) for i, t in found)
