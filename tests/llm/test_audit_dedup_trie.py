"""Filter audit, exact dedup and conversation tries against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import conversation_trie, exact_dedup, filter_audit
from tallyforge.llm.common import cut, join_counted

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_join_counted_keeps_all_rows_of_hot_and_rare_keys(spark):
    left = cut(spark.range(30000).select(F.when(F.col("id") < 20000, 0).otherwise(F.col("id")).alias("k"), "id"))
    right = cut(left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("last")))
    found = join_counted(left, right, ["k"])
    assert found.count() == 30000 and found.where("k = 0 and last = 19999").count() == 20000
    some = join_counted(left, cut(right.where("k < 25000")), ["k"], how="left")
    assert some.count() == 30000 and some.where("last is null").count() == 5000


# exact dedup


def copies(rows):
    texts = [(t or "").translate({c: c + 32 for c in range(65, 91)}) for _, t in rows]
    out = []
    for t in set(texts):
        ids = [i for (i, _), u in zip(rows, texts, strict=True) if u == t]
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), sha(t)) for i in ids]
    return sorted(out, key=repr)


LONG = "".join(random.Random(3).choice("abcdefgh ") for _ in range(5000))
TEXTS = [
    (1, "One text"), (2, "one TEXT"), (3, "one text "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, LONG), (9, LONG.upper()), (10, LONG + "x"), (11, LONG[:-1]),
    (12, "x" + LONG), (13, "aaaaaaaa"), (14, "aaaaaaaaa"), (15, "a" * 16), (16, "a" * 24), (17, "a" * 32), (18, "A" * 24), (None, "one text"), (None, "alone"), (None, "alone"),
    (20, "again"), (20, "again"), (20, "other"), (21, "\x00"), (22, "İ"), (23, "i̇"), (24, "K"), (25, "k"),
]


@pytest.mark.parametrize("size, hashed", [(8, exact_dedup.digest), (1024, lambda block, seed: exact_dedup.digest(block, seed) if seed else (len(block), 0))])
def test_copies_are_those_of_equal_text(spark, size, hashed):
    found = exact_dedup.mark_copies(spark.createDataFrame(TEXTS, "doc_id long, text string"), size=size, hashed=hashed).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=repr) == copies(TEXTS)
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in found})
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_one_row_of_each_text_stays_whatever_the_columns_are_called(spark):
    docs = spark.createDataFrame([(i, t, "key", 1) for i, t in TEXTS], "doc_id long, text string, sha string, key int")
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()), key=repr) == sorted({(k, t.lower()) for i, k, t in kept_ids()}, key=repr)


def kept_ids():
    by = {r[3]: r for r in copies(TEXTS)}
    texts = {sha((t or "").translate({c: c + 32 for c in range(65, 91)})): t or "" for _, t in TEXTS}
    return [(r[0], r[1], texts[h]) for h, r in by.items()]


# filter audit


def test_measures_and_first_ids(spark):
    docs = [
        (1, "a b\ta\n b\x0bc\x1cd", "en"), (2, None, None), (3, "", "en"), (4, "ÀB€ # x", "en"), (5, "ÀB€ # x", "de"), (None, "ÀB€ # x", "en"), (None, "ÀB€ # x", None), (5, "ÀB€ # x", "de"),
        (6, "w" + " w" * 400000 + " V", "en"), (7, " \t\n", "en"),
    ]
    labels = spark.createDataFrame([(4, 1, None), (4, None, 1), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = filter_audit.measured(spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("salt", F.lit(1)), labels).collect()
    low = filter_audit.NULL_ID
    key = lambda r: (r["part"], r["doc_key"], r["first_key"], r["n_words"], r["n_distinct"], r["n_upper"], r["n_chars"], r["symbol"], r["good"], r["toxic"])
    assert sorted(map(key, found)) == sorted([
        ("en", 1, 1, 5, 3, 0, 12, False, False, False), ("", 2, 2, 0, 0, 0, 0, False, False, False), ("en", 3, 2, 0, 0, 0, 0, False, False, False),
        ("en", 4, low, 3, 3, 1, 7, True, True, True), ("de", 5, low, 3, 3, 1, 7, True, False, True), ("de", 5, low, 3, 3, 1, 7, True, False, True),
        ("en", low, low, 3, 3, 1, 7, True, False, False), ("", low, low, 3, 3, 1, 7, True, False, False), ("en", 6, 6, 400002, 2, 1, 800003, False, False, False), ("en", 7, 7, 0, 0, 0, 3, False, False, False),
    ])


@pytest.mark.parametrize("span", [1, 2, 5, 1 << 20])
def test_words_are_counted_alike_in_spans(span):
    r = random.Random(span)
    for _ in range(200):
        text = bytes(r.choice(b"ab \t\n\x0b\x0c\r\x1c\x85") for _ in range(r.randrange(30)))
        words = text.split()
        assert filter_audit.count_words(text, span) == (len(words), len(set(words)))


def by_brute_force(rows, fails, parts):
    out = {}
    for part in parts:
        mine, taken = [r for r in rows if r["part"] == part], Counter()
        for order in permutations(fails):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[f]]
                left = [r for r in left if not r[f]]
                taken[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(bool(r[f]) for r in mine) - len(gone), sum(bool(r[f]) and sum(bool(r[g]) for g in fails) == 1 for r in mine), sum(bool(r["lost"]) for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(taken[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_every_edge_of_every_order(spark):
    r = random.Random(5)
    some = lambda p: r.choices([True, False, None], [p, 1 - p, 0.1])[0]
    rows = [{"part": p, "A": some(0.5), "B": some(0.2), "C": some(0.8), "D": False, "lost": some(0.3)} for p in "xy" for _ in range(40)]
    rows += [{"part": "z", "A": True, "B": True, "C": True, "D": False, "lost": True}]
    table = spark.createDataFrame([tuple(q.values()) for q in rows], "part string, A boolean, B boolean, C boolean, D boolean, lost boolean")
    found = filter_audit.audit(table, {f: f for f in "ABCD"}, losses={"lost_": "lost"}).collect()
    got = {(q["part"], q["filter_order"], q["step"]): (q["kept"], q["removed"], q["redundant"], q["unique_fails"], q["lost_"], q["shapley"]) for q in found}
    assert len(found) == 3 * 24 * 4 and got == by_brute_force(rows, "ABCD", "xyz")


def test_audits_of_other_sizes(spark):
    table = spark.createDataFrame([("x", True), ("x", False)], "part string, A boolean")
    one = filter_audit.audit(table, {"A": "A"}).collect()
    assert [(q["kept"], q["removed"], q["redundant"], q["unique_fails"], q["shapley"]) for q in one] == [(1, 1, 0, 1, 1)]
    assert filter_audit.audit(table.limit(0), {"A": "A"}).collect() == []
    for bad in ({}, {"AB": "A"}, {chr(65 + k): "A" for k in range(9)}):
        with pytest.raises(ValueError):
            filter_audit.audit(table, bad)


# conversation tries


def rebuilt(rows, whole=False):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1]))] for c, v in own.items()}
    if whole:
        return own
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    return {c: own.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[: h(c)] + t[h(c) :] for c, t in own.items()}


def nodes_of(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in who if len(convs[c]) == len(node))
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        children = sum(len(m) == len(node) + 1 for m in below)
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children, len(childless), saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def some_turns():
    r = random.Random(11)
    rows = []
    for c in [*range(60), *range(103, 107), -7, -5, 10**12 + 3]:
        k = r.choice([0, 0, 1, 2, 6])
        rows += [(c, t, "user" if t % 2 else None, f"shared {k} {t}é") for t in range(k)]
        rows += [(c, k + t, r.choice(["user", "assistant"]), r.choice(["yes", "no", None, ""])) for t in range(r.randrange(1, 5))]
    rows += [(200, None, "a", "first"), (200, 5, "b", "last"), (200, 1, None, None), (None, 0, "a", "nobody's"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("most", [1, 3, 256])
def test_tries_by_brute_force(spark, most):
    rows = some_turns()
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, path int")
    found = conversation_trie.trie(turns, most=most, bucket_turns=8)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found.columns == columns
    assert sorted(map(tuple, found.collect()), key=repr) == nodes_of(rebuilt(rows))


def test_long_shared_paths_and_repeated_rows(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(6) for t in range(40)] + [(c, 40, "user", f"own {c // 2}") for c in range(5)] + [(7, 0, "user", "turn 0")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversation_trie.trie(turns, most=1, rebuild=lambda convs: convs)
    assert sorted(map(tuple, found.collect()), key=repr) == nodes_of(rebuilt(rows, whole=True))
    again = conversation_trie.conversations(turns.union(turns.where("conv_id = 7"))).where("conv_id = 7").first()
    assert len(again["turns"]) == 2 and again["turns"][0] == again["turns"][1]


def test_ends_of_many_members_are_hashed_in_ascending_order(spark):
    n = 3 * conversation_trie.PIECE + 5
    members = spark.range(-4, n).select(F.when(F.col("id") % 50 == 7, "few").otherwise("many").alias("key"), F.col("id").alias("conv_id")).orderBy(F.rand(1))
    want = {k: sha(",".join(str(i) for i in range(-4, n) if (i >= 0 and i % 50 == 7) == (k == "few"))) for k in ("few", "many")}
    assert {r["key"]: r["ends"] for r in conversation_trie.hashed_lists(members).collect()} == want


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.mark_copies(docs).collect() == [] and exact_dedup.without_copies(docs).collect() == []
    assert filter_audit.audit_report(docs, labels).collect() == []
    assert conversation_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
