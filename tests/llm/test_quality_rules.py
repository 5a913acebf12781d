import re
from collections import Counter

from tessera.llm import quality_rules as q
from tests.llm import cases

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_statistics_match_plain_python(spark):
    df = cases.documents(spark)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = q.judge(df, labels(spark, [(1, 1, 0), (1, 0, 0), (None, None, None)])).collect()
    assert len(got) == df.count()
    for r in got:
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_tables_without_rows(spark):
    assert q.judge(cases.empty(spark), labels(spark, [])).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in q.judge(cases.documents(spark), labels(spark, [])).collect())


def test_bound_is_the_exact_one():
    assert abs(q.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    for k, n in ((1, 30), (5, 200), (0, 5)):
        p = q.upper_bound(k, n, 0.01)
        from math import comb

        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - 0.01) < 1e-6
    assert q.upper_bound(3, 3, 0.05) == 1.0 and q.upper_bound(0, 0, 0.05) == 1.0


def test_junk_goes_and_good_stays_within_the_allowed_share(spark):
    good = ["plain words number %d stand here without any signs at all so that nothing is wrong %s" % (i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(1500)]
    junk = [" ".join(f"bad{i}{k}###$$$***" for k in range(70)) for i in range(40)]
    df = spark.createDataFrame([(i, x, "en") for i, x in enumerate(good + junk)], "doc_id long, text string, lang string")
    told = labels(spark, [(i, int(i < 1500), 0) for i in range(1540)])
    got = {r["doc_id"]: r["kept"] for r in q.judge(df, told, q.Risk(0.05, 0.05)).collect()}
    assert sum(not got[i] for i in range(1500)) <= 0.05 * 1500
    assert not any(got[i] for i in range(1500, 1540))


def test_a_stratum_with_few_labels_keeps_all(spark):
    df = spark.createDataFrame([(i, " ".join(f"a{i}b{k}####" for k in range(60)), "xx") for i in range(20)], "doc_id long, text string, lang string")
    assert all(r["kept"] for r in q.judge(df, labels(spark, [(i, 1, 0) for i in range(20)])).collect())


def test_cutoffs_and_verdicts_by_brute_force(spark):
    """Every stratum, rule and grid step with exact binomial sums, the null stratum beside the one named ''."""
    import random
    from fractions import Fraction
    from math import comb

    rng = random.Random(6)
    rows, told = [], []
    for i in range(690):
        words = [rng.choice("abcdefghij") * rng.randrange(1, 9) + str(rng.randrange(400)) + "#" * (rng.random() < 0.02 * (i % 11)) for _ in range(rng.randrange(45, 110))]
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        lines += lines[: rng.randrange(3)] if i % 4 == 0 else []
        rows.append((i, "\n".join(lines), ["en", "", None][i % 3]))
        if i % 5:
            told.append((i, int(i % 7 > 0), 0))
    df, risk = spark.createDataFrame(rows, "doc_id long, text string, lang string"), q.Risk(0.3, 0.2)
    got = {r["doc_id"]: r for r in q.judge(df, labels(spark, told), risk).collect()}
    good = {i for i, quality, _ in told if quality}

    def values(r):
        n = max(r["n_words"], 1)
        return {"symbols_per_word": r["n_symbols"] / n, "duplicate_lines": r["n_dup_lines"] / max(r["n_lines"], 1), "repeated_words": r["n_repeat_words"] / n, "long_words": r["word_chars"] / n, "short_words": -r["word_chars"] / n}

    share, level = Fraction(risk.max_false_rejection / len(q.RULES)), risk.delta / (len(q.RULES) * 3)
    used = 0
    for lang in ("en", "", None):
        own = [r for r in got.values() if r["stratum"] == lang]
        teach = [values(r) for r in own if r["doc_id"] in good and not r["base_failed"]]
        cut = {}
        for rule, (_, grid) in q.RULES.items():
            for c in grid:
                k, n = sum(v[rule] > c for v in teach), len(teach)
                chance = sum(comb(n, x) * share**x * (1 - share) ** (n - x) for x in range(k + 1))
                if k >= n or chance > level:
                    break
                cut[rule] = c
        used += len(cut)
        for r in own:
            failed = [rule for rule in q.RULES if rule in cut and values(r)[rule] > cut[rule]]
            assert r["rejected_by"] == failed and r["kept"] == (not failed and not r["base_failed"]), (r, cut)
    assert used > 6 and any(r["rejected_by"] for r in got.values())
