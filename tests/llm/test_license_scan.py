import re

from tessera.llm import license_scan as ls
from tests.llm import cases


def pairs(text):
    lower = text.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", lower)
    return set(zip(w, w[1:]))


def brute(text, percent=90):
    found = []
    for line, unit in [(-1, text or ""), *enumerate((text or "").split("\n"))]:
        own = pairs(unit)
        best = max(((2 * len(own & pairs(v)) / (len(own) + len(pairs(v))), k) for k, v in sorted(ls.TEMPLATES.items()) if own), default=(0, ""), key=lambda x: x[0])
        if own and 100 * best[0] >= percent - 1e-9:
            found.append((line, best[1], round(best[0], 9)))
    return found


def texts():
    mit = ls.TEMPLATES["mit"]
    return [mit, mit.replace(" ", "\n"), "Copyright (c) 2020 Someone\n" + mit, mit[: len(mit) // 2], "intro\nALL RIGHTS -- reserved!\nReleased under the MIT license\nx", ls.TEMPLATES["isc"].upper(), "all rights", "é rights reserved", "\n\nall rights reserved\n", ls.TEMPLATES["gpl-3.0-notice"].replace("hope", "wish")]


def test_against_all_templates(spark):
    df = cases.documents(spark, cases.TEXTS + texts())
    held = {r["doc_id"]: r["text"] for r in df.collect()}
    got = ls.scan(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert [(m["line"], m["license"], round(m["dice"], 9)) for m in r["matches"]] == brute(held[r["doc_id"]]), held[r["doc_id"]]
    assert ls.scan(cases.empty(spark)).count() == 0


def test_wrapped_and_embedded_licences(spark):
    import textwrap

    story = "\n".join(f"This is line {i} of a long story about nothing much at all." for i in range(60))
    full = ls.window_templates()
    names = ["mit", "isc", "bsd-2-clause", "bsd-3-clause", "apache-2.0-notice", "gpl-3.0-notice", "agpl-3.0-notice", "unlicense", "apache-2.0-text", "gpl-3-text"]
    texts = [f"{story}\n{textwrap.fill(full[n], 70)}\n{story}" for n in names] + ["Copyright 2020 X. All rights reserved.", "x\nit is released under the MIT license, see there", story]
    got = {r["doc_id"]: r["matches"] for r in ls.scan(cases.documents(spark, texts)).collect()}
    for i, n in enumerate(names):
        assert [(m["line"], m["license"]) for m in got[i]][:1] == [(60, n)] and got[i][0]["dice"] > 0.99, (n, got[i])
    assert [(m["line"], m["license"]) for m in got[len(names)]] == [(0, "all-rights-reserved")]
    assert [(m["line"], m["license"]) for m in got[len(names) + 1]] == [(1, "mit-line")]
    assert got[len(names) + 2] == []


def test_no_templates(spark):
    assert all(r["n_matches"] == 0 for r in ls.scan(cases.documents(spark), {}).collect())


def test_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    expected = sorted(con.sql(ls.oracle()).fetchall())
    assert sorted(map(tuple, ls.query(spark, sf_dir).collect())) == expected
    assert any(r[1] for r in expected)


def plain_windows(words, templates, percent=90):
    """Every window from every start, sets built anew; then the same choice among them."""
    found = []
    for name, body in templates.items():
        w = re.findall("[a-z0-9]+", body)
        own = set(zip(w, w[1:]))
        most = len(w) - 1 + -(-(len(w) - 1) // 4)  # a window holds repeats as the template does
        b = list(zip(words, words[1:]))
        options = []
        for i in range(len(b)):
            best = None
            for j in range(i, min(i + most, len(b))):
                part = set(b[i : j + 1])
                dice = 2 * len(part & own) / (len(part) + len(own))
                if b[i] in own and b[j] in own and 200 * len(part & own) >= percent * (len(part) + len(own)) and (best is None or dice > best[0]):
                    best = (dice, i, j + 1, len(part & own))
            if best:
                options.append((-best[0], *best[1:]))
        taken = set()
        for dice, a, z, shared in sorted(options):
            if not taken & set(range(a, z)):
                taken |= set(range(a, z))
                found.append((-shared, dice, name, a, z))
    covered, out = {}, []
    for shared, dice, name, a, z in sorted(found):
        if max((covered.get(x, 0) for x in range(a, z)), default=0) < -shared:
            covered |= dict.fromkeys(range(a, z), -shared)
            out.append((name, round(-dice, 9)))
    return sorted(out)


def test_windows_against_sets_built_anew():
    import random

    import pyarrow as pa

    rng = random.Random(4)
    templates = {"x": " ".join(rng.choice("abcdef") for _ in range(30)), "y": " ".join(rng.choice("defgh") + str(rng.randrange(3)) for _ in range(24))}
    windows = ls.Windows(templates)
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            body = list(rng.choice(list(templates.values())).split())
            for _ in range(rng.randrange(3)):
                body[rng.randrange(len(body))] = rng.choice("abz")
            words += [rng.choice("abcdefz") for _ in range(rng.randrange(6))] + body
        texts.append(" ".join(words))
    got = windows.scan(pa.array(texts), 90, [])
    assert any(got)
    for k, text in enumerate(texts):
        assert sorted((name, round(dice, 9)) for t, _, name, dice in got if t == k) == plain_windows(text.split(), templates)


def test_many_long_licences_in_one_text(spark):
    import time

    import pyarrow as pa

    full = ls.window_templates()
    windows = ls.Windows(full)
    text = "\n\nand so on and on\n\n".join([full["gpl-3-text"]] * 8)
    began = time.process_time()
    got = windows.scan(pa.array([text]), 90, [])
    assert [name for _, _, name, _ in got] == ["gpl-3-text"] * 8 and all(dice > 0.99 for *_, dice in got)
    assert time.process_time() - began < 3  # measuring every start took hundreds
