"""The manifest, the rule ledger and lexical search against brute force, on edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from featlake.llm import lexical_search, merkle, quality_rules

LOW = str.maketrans(merkle.UPPER, merkle.LOWER)
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([digest("".join(row[at : at + 16])) for at in range(0, len(row), 16)])
    return levels


def path(levels, at):
    out = []
    for row in levels[:-1]:
        start = at // 16 * 16
        out.append(("".join(row[start:at]), "".join(row[at + 1 : start + 16])))
        at //= 16
    return out


def brute_manifest(rows):
    def leaf(row):
        values = [None if row[c] is None else str(row[c]) for c in merkle.FIELDS]
        return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))

    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by_source[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [climb([leaf(r) for r in by_source[s]]) for s in sources]
    top = climb([t[-1][0] for t in trees])
    for k, (s, tree) in enumerate(zip(sources, trees)):
        for at, row in enumerate(by_source[s]):
            way = path(tree, at) + path(top, k)
            node = leaf(row)
            if row["doc_id"] is not None and row["text"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                node = leaf({**row, "text": row["text"].translate(LOW)})
            for before, after in way:
                node = digest(before + node + after)
            proof = digest("".join(b + a for b, a in way))
            yield (row["doc_id"], tree[0][at], tree[-1][0], top[-1][0], proof, node, node == top[-1][0])


EDGE = [
    (1, "Plain Text", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, "a", 0),
    (4, "ÉTÉ 日本語 Ω", "fr", None, 9),
    (5, "A", None, "", 1),
    (None, "No Id", "en", "a", 5),
    (7, "Twice", "en", "é", 5),
    (7, "Twice", "en", "é", 5),
    (7, "Other", "en", "é", 5),
    (8, "alone here", "en", "Zed", 10),
    (9, "Long " * 40_000, "en", "a", 200_000),
]


def manifest_rows(spark, docs):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(str, (tuple(r) for r in merkle.verified(docs).select(columns).collect())))


@pytest.mark.parametrize("many", [0, 9_000])
def test_manifest_equals_brute_force(spark, many):
    docs = spark.createDataFrame(EDGE, DOC)
    if many:  # several blocks and layers in one source, many small sources
        more = spark.range(100, 100 + many).select(
            F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"),
            F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 300).cast("string")).alias("source"), F.lit(4).cast("bigint").alias("n_chars"),
        )
        docs = docs.unionByName(more)
    docs = docs.withColumn("tree", F.lit("x")).withColumn("pos", F.lit(1)).repartition(5)
    assert manifest_rows(spark, docs) == sorted(map(str, brute_manifest([r.asDict() for r in docs.collect()])))


def test_manifest_of_nothing_and_of_one(spark):
    docs = spark.createDataFrame(EDGE[:1], DOC)
    assert merkle.verified(docs.where("false")).count() == 0
    (row,) = merkle.verified(docs).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == digest("")


def test_fold_resumes_what_a_rebuild_gives():
    leaves = [digest(str(k)) for k in range(300)]
    block = merkle.Block(leaves, 3)
    assert block.top == climb(leaves)[-1][0]
    for at in (0, 15, 16, 255, 256, 299):
        changed = [*leaves[:at], digest("x"), *leaves[at + 1 :]]
        assert block.fold(at, digest("x")) == climb(changed)[-1][0]
        assert block.fold(at, leaves[at]) == block.top


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


TEXTS = [
    None, "", " \t\n\x0b\f\r ", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 15, "a " * 16 + "b", "x\ny\nx\n \n\nx", "# * $ % & | < >",
    "日本語 été 𝒳 " * 9, "  　 one", "one two three four five six seven eight nine ten " * 30, "word " * 60_000,
    " ".join(f"w{k % 977}" for k in range(30_000)), "a,b. c\x00d \x1f e",
]


def test_ledger_equals_brute_force(spark):
    rows = [(k % 13, t, 5, "c", "d", [1], 2) for k, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words bigint, failed string, _words string, _row array<int>, kept_v1 int")
    found = quality_rules.apply_policies(quality_rules.ledger(docs)).collect()
    assert len(found) == len(rows)
    want = Counter()
    for doc_id, text, *_ in rows:
        m = brute_measures(text)
        failed = sum(1 << bit for bit, rule in enumerate(quality_rules.RULES.values()) if eval(rule, {}, m))
        want[doc_id, tuple(m.values()), failed, *(not failed & quality_rules.mask(p) for p in quality_rules.POLICIES.values())] += 1
    got = Counter((r.doc_id, tuple(r[c] for c in quality_rules.MEASURES), r.failed, r.kept_v1, r.kept_v2, r.kept_v3) for r in found)
    assert got == want
    assert quality_rules.ledger(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        quality_rules.mask(("no_such_rule",))


def test_ablations_equal_brute_force(spark):
    bits = [0, 0, 1, 1, 2, 3, 8, 9, 12, 63, 48]
    rows = spark.createDataFrame([(b,) for b in bits], "failed bigint")
    found = {(r.version, r.rule): (r.n_failed, r.n_alone, r.n_kept, r.n_kept_without) for r in quality_rules.ablations(rows).collect()}
    for version, rules in quality_rules.POLICIES.items():
        all_ = quality_rules.mask(rules)
        kept = sum(not b & all_ for b in bits)
        for rule in rules:
            one = quality_rules.mask((rule,))
            alone = sum(b & all_ == one for b in bits)
            assert found.pop((version, rule)) == (sum(bool(b & one) for b in bits), alone, kept, sum(not b & (all_ ^ one) for b in bits))
            assert kept + alone == sum(not b & (all_ ^ one) for b in bits)
    assert not found
    assert quality_rules.ablations(rows.where("false")).count() == 0


def test_ledger_plan_has_no_python_and_no_shuffle(spark):
    plan = quality_rules.ledger(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def brute_search(docs, items, k):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    counts = [(d, Counter(find(t))) for d, t in docs if find(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(find(text)) if t in c)
            if score and doc is not None:
                scores.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


SEARCHED = [
    (1, "the mill on the hill"), (2, "The Mill; on-the (hill)"), (3, None), (4, ""), (5, "... !!"), (6, "mill " * 50_000), (7, "été ÉTÉ Été 日本"),
    (8, "x1 y2_z3 hill"), (8, "x1 y2_z3 hill"), (8, "another text of id 8"), (None, "the hill has no id"), (10, "grain\x00mill\x1fgrain\x7fhill"),
]
ITEMS = [(1, "The mill hill"), (2, None), (3, ""), (4, "nothing.of.it"), (5, "été 日本 hill hill HILL"), (5, "été 日本 hill hill HILL"), (None, "grain z3"), (7, "the")]


@pytest.mark.parametrize("batch_terms", [3, 100_000])
def test_search_equals_brute_force(spark, monkeypatch, batch_terms):
    monkeypatch.setattr(lexical_search, "BATCH_TERMS", batch_terms)
    docs = spark.createDataFrame([(d, t, 1, "m") for d, t in SEARCHED], "doc_id bigint, text string, n int, m string").repartition(3)
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id bigint, text string, rank int")
    found = sorted((tuple(r) for r in lexical_search.search(docs, items, k=4).collect()), key=str)
    assert found == brute_search(SEARCHED, ITEMS, 4)
    for d, i in ((docs.where("false"), items), (docs, items.where("false"))):
        assert lexical_search.search(d, i).count() == 0


def test_search_over_blocks_of_one_stratum_and_many_ties(spark):
    rows = [(k, f"w{k % 7} w{k % 5} v{k % 1500} tail") for k in range(5_000)] + [(9_000 + k, "w1 w2 " * (k + 1)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    items = [(1, "w1 w2 v3"), (2, "tail"), (3, "v77 w0"), (4, "w6")]
    found = sorted((tuple(r) for r in lexical_search.search(docs, spark.createDataFrame(items, "item_id bigint, text string"), 50).collect()), key=str)
    assert found == brute_search(rows, items, 50)
