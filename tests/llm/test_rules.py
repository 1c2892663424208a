from llm_cases import edge_rows
from pyspark.sql import functions as F

from mediaspark.llm import quality_rules as q


def brute(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(marked)


def test_measures_equal_brute_force(spark, edge, prose):
    texts = [t for _, t, _ in edge_rows() if len(t or "") < 5000] + [t + "\nfoo bar\n" + t for t in prose(40, 5, 1, 30)]
    for t in texts:
        m = q.measure((t or "").encode())
        assert (m[0], m[1], m[2], m[4], m[5]) == brute(t), t


def test_ledger_bears_edges(spark, edge, empty):
    rows = q.ledger(edge, keep=("doc_id", "k0", "t")).collect()
    assert len(rows) == len(edge_rows())
    null = [r for r in rows if r.doc_id == 2][0]
    assert null.n_words == 0 and null.failed_bits & 1
    assert q.ledger(empty).count() == 0 and q.kept(empty).count() == 0
    kept = q.kept(edge)
    assert kept.columns == edge.columns
    assert kept.count() == q.ledger(edge).filter(~q.rejected()).count()


def test_policies_and_ablations(spark):
    bits = [0, 1, 2, 3, 4, 4, 0b1000, 0b1100, 0]
    rows = spark.createDataFrame([(b,) for b in bits], "failed_bits long")
    assert rows.filter(q.rejected(1)).count() == 3
    got = {r.rule: r for r in q.ablations(rows, 3).collect()}
    for rule in q.RULES:
        own = 1 << rule.bit
        assert got[rule.name].failed == sum(bool(b & own) for b in bits)
        assert got[rule.name].failed_alone == sum(b == own for b in bits)
        assert got[rule.name].kept_without == sum(b & ~own == 0 for b in bits)


def test_each_rule_can_fail():
    names = [x.split()[0] for x in q.MEASURES.split(", ")]
    cases = {
        "too_few_words": "few words", "symbol_ratio": "a# b c " * 40, "marked_words": "word%%% " * 60, "bar_lists": "x | y | " * 40,
        "duplicate_lines": "same line\n" * 10, "shouting": "LOUD WORDS HERE " * 20, "long_words": "x" * 50,
        "one_word": "the " * 60, "short_words": "a b c " * 30, "repeated_windows": "one two three " * 20,
    }
    for rule in q.RULES:
        m = dict(zip(names, q.measure(cases[rule.name].encode())))
        assert eval(rule.fails.replace("AND", "and"), {}, m), rule.name


def test_clean_prose_is_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    rows = q.ledger(docs).join(labels, "doc_id").filter("n_words >= 50")
    assert rows.filter(q.rejected()).count() == 0
    bad = q.ledger(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 0"), "doc_id")
    assert bad.filter(q.rejected()).count() == bad.count()
    assert rows.select(F.max("failed_bits")).first()[0] == 0
