"""Suffix dedup, resampling and conversation repair against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from tallyloom.llm import dialogue, resample, suffix_dedup
from tests.llm.test_operators import DOCS, EDGE, docs, words

SF = "/root/testdata/sf0.001"


# suffix dedup


def brute_removed(texts, length=200):
    """The maximal removed runs of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, dtype=np.int8)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = 1
        edge = np.flatnonzero(np.diff(gone))
        out.append(list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def hard_texts():
    rng = random.Random(5)
    shared, base = words(rng, 60), words(rng, 300)
    texts = [None, "", "a" * 199, "a" * 700, "é" * 150, "ab" * 400 + words(rng, 20), shared, shared[:200], shared[1:201] + "x", shared[:199]]
    texts += [words(rng, rng.randint(1, 80)) + shared[rng.randint(0, 40) :] + words(rng, 50) for _ in range(20)]
    for _ in range(20):
        near = base.split(" ")
        for _ in range(rng.randint(1, 8)):
            near[rng.randrange(len(near))] = words(rng, 1)
        texts.append(" ".join(near))
    return [*texts, base, base, base, words(rng, 400), "x" + "yz" * 130 + shared + "yz" * 130]


def by_text(rows):
    """Spans and what stays of each text, which equal texts share."""
    out = {}
    for r in rows:
        got = [(x.start, x.end) for x in r.removed], bytes(r.kept)
        assert out.setdefault(bytes(r.raw), got) == got
    return out


def check_removed(rows, texts, length):
    got, want = by_text(rows), brute_removed(texts, length)
    assert len(rows) == len(texts)
    for t, spans in zip(texts, want, strict=True):
        raw = (t or "").encode()
        edges = [0, *(x for s in spans for x in s), len(raw)]
        assert got[raw] == (spans, b"".join(raw[s:e] for s, e in zip(edges[0::2], edges[1::2], strict=True)))


@pytest.mark.parametrize(("length", "key_bytes", "hot"), [(200, 64, 4096), (40, 8, 4096), (40, 8, 3), (200, 64, 2)])
def test_repeated_bytes_against_brute_force(spark, length, key_bytes, hot):
    texts = hard_texts()
    rows = suffix_dedup.dedup_suffixes(docs(spark, list(enumerate(texts))), length, key_bytes, hot).collect()
    check_removed(rows, texts, length)


def test_suffixes_of_the_smallest_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in df.select("text").collect()]
    check_removed(suffix_dedup.dedup_suffixes(df).collect(), texts, 200)


def test_long_texts_are_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 1000)
    rng = random.Random(9)
    shared = words(rng, 100)
    texts = [words(rng, 2000) + shared + words(rng, 500), shared + "q" * 5000]
    found = list(suffix_dedup._slices([t.encode() for t in texts], 200))
    strings = {(row, at + i) for g in found for row, at, part in g for i in range(len(part) - 199)}
    assert len(strings) == sum(len(g[2]) - 199 for f in found for g in f) == sum(len(t.encode()) - 199 for t in texts)
    check_removed(suffix_dedup.dedup_suffixes(docs(spark, list(enumerate(texts)))).collect(), texts, 200)


def test_symbols_of_one_name_are_told_apart(monkeypatch):
    """A poor hash gives many wide symbols one name: the bytes decide."""
    honest = suffix_dedup.hashes
    monkeypatch.setattr(suffix_dedup, "hashes", lambda buf, n: honest(buf, n) % np.uint64(3))
    rng = random.Random(2)
    some = [bytes(rng.choice(b"abc") for _ in range(300)) for _ in range(20)]
    some += [some[0][50:280] + b"x", some[1][:200]]
    seen = Counter(p[i : i + 200] for p in some for i in range(len(p) - 199))
    for p, hit in zip(some, suffix_dedup.repeated(some), strict=True):
        assert hit.tolist() == [seen[p[i : i + 200]] > 1 for i in range(len(p) - 199)]


@pytest.mark.parametrize("length", [16, 40, 80])
def test_columns_sort_any_pieces(length):
    rng = random.Random(1)
    for _ in range(60):
        alphabet = rng.choice([b"a", b"ab", b"abcdef\x00\xff"])
        some = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 150))) for _ in range(rng.randint(1, 12))]
        some += [some[0][: rng.randint(0, 80)] + b"b"] * rng.randint(0, 2)
        seen = Counter(p[i : i + length] for p in some for i in range(len(p) - length + 1))
        for p, hit in zip(some, suffix_dedup.repeated(some, length), strict=True):
            assert hit.tolist() == [seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]


def test_least_values_of_ranges():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 26, 777).astype(np.uint8)
    lo = rng.integers(0, 777, 3000)
    hi = np.minimum(lo + rng.integers(0, 400, 3000), 776)
    assert suffix_dedup.Minima(values).of(lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def test_suffix_edge_cases(spark):
    rows = [*EDGE, (7, "z" * 300), (None, "é" * 200)]
    df = docs(spark, rows).withColumnsRenamed({"lang": "raw", "source": "of"}).withColumnRenamed("n_chars", "key")
    check_removed(suffix_dedup.dedup_suffixes(df).collect(), [r[1] for r in rows], 200)
    assert suffix_dedup.dedup_suffixes(spark.createDataFrame([], DOCS)).count() == 0
    got = suffix_dedup.digests(suffix_dedup.dedup_suffixes(docs(spark, [(1, "z" * 300), (2, "q")]))).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 300, 300, 1, hashlib.sha256(b"").hexdigest()), (2, 1, 0, 0, hashlib.sha256(b"q").hexdigest())]


# resampling


def brute_words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute_weights(rows, target, n=1, buckets=10_000, percent=10, least=20, seed="2024"):
    grams = lambda t: [" ".join(w[i : i + k]) for w in [brute_words(t)] for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda g: crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x)) for texts in ([x for _, x in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for doc_id, text in rows:
        own = [gain(bucket(g)) for g in grams(text)]
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(brute_words(text)) >= least, None])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for i, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = i
    return sorted((tuple(r[:4] + r[5:]) for r in out), key=str)


@pytest.mark.parametrize(("n", "percent"), [(1, 10), (1, 100), (3, 35)])
def test_weights_and_draw_against_brute_force(spark, n, percent):
    df, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = resample.weigh(df, target, n=n, percent=percent).drop("n_words").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_weights(rows, [r.text for r in target.collect()], n, percent=percent)


def test_lines_count_as_often_as_they_stand(spark):
    line = "Über alles WORD word, 12 a-b " * 5
    rows = [(1, f"{line}\n{line}\n\n{line}"), (2, line), (2, line), (2, "x\ny\r\nz " * 9), *EDGE]
    df = docs(spark, rows).withColumnsRenamed({"lang": "line", "source": "of"}).withColumnRenamed("n_chars", "rows")
    for n in (1, 2, 4):
        got = resample.weigh(df, docs(spark, [(1, line), (2, None)]), n=n, percent=60).drop("n_words").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_weights([r[:2] for r in rows], [line, None], n, percent=60)


def test_resampling_empty_tables_and_texts(spark):
    none = spark.createDataFrame([], DOCS)
    assert resample.weigh(none, none).count() == 0
    rows = [(i, f"w{i} " * 30) for i in range(40)]
    got = resample.weigh(docs(spark, rows), none, percent=25)
    assert sorted((tuple(r) for r in got.drop("n_words").collect()), key=str) == brute_weights(rows, [], percent=25)
    drawn = resample.resample(docs(spark, rows), none, percent=25)
    assert drawn.columns == docs(spark, rows).columns and drawn.count() == 10


# conversation repair


def brute_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Least (cost, audit, repaired) over all edits, by trying everything."""
    faults, best = brute_faults(rows), None
    choices = [[("D", 4, None)] + ([] if f in ("blank", "duplicate") else [("K", 3 * (f == "truncated"), r)] + [("R", 3 + 3 * (f == "truncated"), (role, r[1])) for role in ("user", "assistant")]) for r, f in zip(rows, faults, strict=True)]
    gaps = [()] + [x for k in (1, 2) for x in itertools.product(("user", "assistant"), repeat=k)]
    for picked in itertools.product(*choices):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(c for _, c, _ in picked) + 3 * sum(map(len, inserted))
            if best is not None and cost > best[0]:
                continue
            turns, audit = [(r, "") for r in inserted[0]], "I" * len(inserted[0])
            for (letter, _, turn), more in zip(picked, inserted[1:], strict=True):
                turns += [turn] * (turn is not None) + [(r, "") for r in more]
                audit += letter + "I" * len(more)
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or " " for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, turns
    return best


def dp_repair(rows):
    """The same for long conversations: the least (cost, audit) to each state, row by row."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    made = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserts(ways):
        for _ in range(3):
            for st, (c, a) in list(ways.items()):
                to = made[st]
                ways[to] = min(ways.get(to, (math.inf, "")), (c + 3, a + "I"))
        return ways

    ways = inserts({"": (0, "")})
    for (role, _), f in zip(rows, brute_faults(rows), strict=True):
        new = {}
        for st, (c, a) in ways.items():
            cut = 3 * (f == "truncated")
            options = [(st, c + 4, a + "D")]
            if f in ("", "truncated"):
                options += [(made[st], c + 3 + cut, a + "R")]
                if role[:1] in step[st]:
                    options += [(step[st][role[:1]], c + cut, a + "K")]
            for to, *way in options:
                new[to] = min(new.get(to, (math.inf, "")), tuple(way))
        ways = inserts(new)
    return min(ways[s] for s in ("", "a") if s in ways)


def random_rows(rng, n):
    texts = ["Yes.", "No", "", " \t", "Why?", "Well then", " ", "Go!"]
    return [(rng.choice(["user", "assistant", "system", "tool", " ", "user", "assistant"]), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}.") for _ in range(n)]


def searched(rows):
    code = {"": dialogue.SOUND, "blank": dialogue.BLANK, "duplicate": dialogue.DUPLICATE, "truncated": dialogue.TRUNCATED}
    return dialogue.search([(r[:1], code[f]) for (r, _), f in zip(rows, brute_faults(rows), strict=True)])


def test_search_against_all_edits():
    rng = random.Random(4)
    for _ in range(120):
        rows = random_rows(rng, rng.randint(0, 3))
        cost, audit, turns = brute_repair(rows)
        assert searched(rows) == (cost, audit)
        assert dialogue.edited(rows, audit)[0] == turns
        assert dp_repair(rows) == (cost, audit)


def test_search_of_long_conversations_is_linear():
    rng = random.Random(6)
    for n in (30, 300, 20_000):
        rows = random_rows(rng, n)
        cost, audit = searched(rows)
        if n < 1000:
            assert (cost, audit) == dp_repair(rows)


def expected(rows):
    """What repair_damaged says, from rows of conv_id, turn, role, text."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        kind, role, text = crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in own if t is not None]
        said = [(r, x) for _, r, x in own]
        faults, initials = Counter(brute_faults(said)), [r[:1] for r, _ in said]
        cost, audit = dp_repair(said)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in dialogue.edited(said, audit)[0]).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha)
    return out


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def hard_conversations():
    rng = random.Random(8)
    rows = [(c, t, *r) for c in range(60) for t, r in enumerate(random_rows(rng, rng.randint(0, 9)))]
    rows += [(100, t, *r) for t, r in enumerate(random_rows(rng, 400))]
    rows += [(None, t, "user", "Yes.") for t in (None, None, 1, 5, 5)] + [(101, None, None, None), (102, 3, "user", None), (103, 2**40, "", "Hm."), (103, -5, "a", "Hm.")]
    return rows + rows[:7]


def test_damaged_conversations_against_brute_force(spark):
    rows = hard_conversations()
    want = expected(rows)
    got = dialogue.repair_damaged(conversations(spark, rows)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_conversations_over_many_partitions(spark, monkeypatch):
    """One row to a partition or two: every conversation lies in several."""
    rows = hard_conversations()
    monkeypatch.setattr(dialogue, "PART_ROWS", 3)
    got = dialogue.repair_damaged(conversations(spark, rows)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows)
    turns = dialogue.repaired_turns(dialogue.damage(conversations(spark, rows))).orderBy("conv_id", "place").collect()
    by = defaultdict(list)
    for r in turns:
        assert r.place == len(by[r.conv_id])
        by[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(by[c]).encode()).hexdigest() for c in {r[0] for r in rows}} == {r.conv_id: r.repaired_sha256 for r in got}


def test_conversations_of_the_smallest_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    got = dialogue.repair_damaged(df).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows)
    extra = df.withColumnsRenamed({}).selectExpr("*", "1 as part", "2 as digest")
    assert sorted(map(tuple, dialogue.repair_damaged(extra).collect())) == sorted(map(tuple, got))


def test_empty_conversations(spark):
    assert dialogue.repair_damaged(conversations(spark, [])).count() == 0
    assert dialogue.repaired_turns(conversations(spark, [])).count() == 0
