import math
from collections import Counter, defaultdict

from tessera.llm import kneser_ney as kn
from tests.llm import cases


def plain(texts, order):
    """log p of a padded text under the interpolated model."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        b = bytes([254]) * order + (t or "").encode() + bytes([255])
        counts[order].update(b[i - order : i + 1] for i in range(order, len(b)))
    for j in range(order - 1, -1, -1):
        counts[j].update(g[1:] for g in counts[j + 1])
    cut = []
    for table in counts:
        n = [sum(c == k for c in table.values()) for k in range(5)]
        if not (n[1] and n[2]):
            cut.append((0.5, 0.75, 0.9))
            continue
        y = n[1] / (n[1] + 2 * n[2])
        d = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2] if n[3] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] and n[4] else 1.5)
        cut.append(tuple(min(max(x, 0.1), k - 0.05) for k, x in enumerate(d, 1)))
    followers = [defaultdict(list) for _ in counts]
    for j, table in enumerate(counts):
        for g, c in table.items():
            followers[j][g[:-1]].append(c)

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / 255
        j, own = len(g) - 1, followers[len(g) - 1].get(g[:-1])
        if not own:
            return lower
        d = lambda c: cut[j][min(c, 3) - 1]
        c = counts[j][g]
        return ((c - d(c) if c else 0.0) + sum(map(d, own)) * lower) / sum(own)

    def score(t):
        b = bytes([254]) * order + (t or "").encode() + bytes([255])
        return sum(math.log(p(b[i - order : i + 1])) for i in range(order, len(b))), len(b) - order

    return score


def test_perplexity_matches_the_plain_model(spark):
    texts = cases.TEXTS[:9] + ["the cat sat", "on the mat", "un chat où", "the dog"] * 3
    df = cases.documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(len(texts))] + [(5, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    told = {r["doc_id"] for r in kn.trusted_ids(labels).filter("train").collect()}
    assert told < {i for i in range(len(texts)) if i % 3 > 0 and i != 5}
    rows = df.collect()
    score = plain([r["text"] for r in rows if r["doc_id"] in told], 2)
    text = {r["doc_id"]: r["text"] for r in rows}
    got = kn.perplexities(df, labels, order=2, chunk_bytes=300).collect()
    assert len(got) == len(rows)
    for r in got:
        log_p, n = score(text[r["doc_id"]])
        assert r["trained"] == (r["doc_id"] in told) and r["n_symbols"] == n
        assert abs(r["perplexity"] - math.exp(-log_p / n)) < 1e-6 * r["perplexity"]


def test_junk_is_rejected_and_prose_kept(spark):
    prose = ["the small house by the river was quiet and old number %d" % i for i in range(120)]
    junk = [f"#$%& @@!! zzqx {i} ~~~ ^^^" for i in range(10)]
    df = spark.createDataFrame([(i, x, "en") for i, x in enumerate(prose + junk)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in kn.classify(df, labels).collect()}
    assert sum(kept[i] for i in range(120)) >= 118 and not any(kept[i] for i in range(120, 130))


def test_no_rows_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kn.classify(cases.empty(spark), none).count() == 0
    assert all(r["kept"] for r in kn.classify(cases.documents(spark), none, order=2).collect())


def test_thresholds_against_brute_force(spark, sf_dir):
    """Each language's quantile, the quantile over all where there are too few rows, ties kept; held-out rows are not trained on."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = kn.classify(docs, labels, quantile=0.8, min_trusted=3).collect()
    train = {r["doc_id"]: r["train"] for r in kn.trusted_ids(labels).collect()}

    def cut(values):
        values = sorted(values)
        return values[-(-8 * len(values) // 10) - 1] * kn.MARGIN

    held = [r for r in rows if train.get(r["doc_id"]) is False]
    own = {}
    for lang in {r["lang"] for r in rows} - {None}:
        values = [r["perplexity"] for r in held if r["lang"] == lang]
        if len(values) >= 3:
            own[lang] = cut(values)
    overall = cut([r["perplexity"] for r in held])
    assert own and len(held) > sum(r["lang"] in own for r in held)  # both cases occur
    for r in rows:
        assert math.isclose(r["threshold"], own.get(r["lang"], overall), rel_tol=1e-6)
        assert r["kept"] == (r["perplexity"] <= r["threshold"])
        assert r["trained"] == bool(train.get(r["doc_id"]))
