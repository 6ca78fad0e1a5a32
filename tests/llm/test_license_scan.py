import math
import re
import textwrap
from collections import Counter

from cinelake.llm.license_scan import TEMPLATES, scan

FILES = [
    ("/LICENSE", 1, "Released under the MIT License."),
    ("/src/a.py", 2, "code only"),
    ("/src/lib/LICENSE.txt", 3, "Licensed under the Apache License, Version 2.0."),
    ("/src/lib/deep/b.py", 4, None),
    ("/src/lib/c.py", 5, "x = 1\nThis work is licensed under the GNU General Public License, version 3.\nlong code follows here " + "w " * 50),
    ("/srclib/d.py", 6, ""),
    ("/src/lib/deep/b.py", 4, None),
    (None, 7, "nothing"),
    ("/other/e.txt", 8, "all rights to copyright nonsense zebra quux\n" + "w " * 50),
    ("f.txt", 9, "bare"),
]


def test_headers_and_nearest_directory(spark):
    got = scan(spark.createDataFrame(FILES, "path string, key long, text string")).collect()
    out = sorted((r.key, r.own_license, r.license, r.inherited_from) for r in got)
    assert out == [
        (1, "MIT", "MIT", None), (2, None, "MIT", ""), (3, "Apache-2.0", "Apache-2.0", None), (4, None, "Apache-2.0", "/src/lib"), (4, None, "Apache-2.0", "/src/lib"),
        (5, "GPL-3.0", "GPL-3.0", None), (6, None, "MIT", ""), (7, None, None, None), (8, None, "MIT", ""), (9, None, "MIT", ""),
    ]


def test_cosine_equals_brute_force(spark):
    files = [(f"/d/{i}", i, t) for i, (_, t) in enumerate(TEMPLATES)] + [("/d/x", 99, "licensed under the apache license")]
    lines = [re.findall("[a-z0-9]+", t.lower()) for _, _, t in files if re.search("(?i)licen[cs]|copyright|spdx-|public domain|permission is|permission to|redistribut", t)]
    df = Counter(w for x in lines for w in set(x))
    idf = lambda w: math.log((len(lines) + 1) / (df[w] + 1)) + 1
    vec = lambda x: {w: n * idf(w) for w, n in Counter(x).items()}
    cos = lambda a, b: sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    got = {r.key: r for r in scan(spark.createDataFrame(files, "path string, key long, text string")).collect()}
    for _, key, text in files:
        v = vec(re.findall("[a-z0-9]+", text.lower()))
        best = min((-round(cos(v, vec(re.findall("[a-z0-9]+", t.lower()))), 9), n) for n, t in TEMPLATES)
        if got[key].own_license is not None:
            assert got[key].own_license == best[1] and abs(got[key].cosine + best[0]) < 1e-5


def test_empty(spark):
    assert scan(spark.createDataFrame([], "path string, key long, text string")).count() == 0


def test_wrapped_notices(spark):
    files = [(f"/{n}/{w}/{i}.py", 100 * w + i, "\n".join(["import os", "", *("# " + x for x in textwrap.wrap(t, w)), "", "x = 1"])) for w in (40, 60, 72) for i, (n, t) in enumerate(TEMPLATES)]
    mit = next(t for n, t in TEMPLATES if n == "MIT" and "hereby" in t)
    files += [("/lib/LICENSE", 9000, "MIT\n\n" + textwrap.fill(mit, 30).replace(" ", "  ")), ("/lib/a/b.c", 9001, "int x;")]
    files += [("/z/COPYING", 9002, "\n\n".join(textwrap.wrap(mit, 30))), ("/z/a.c", 9003, "int y;")]
    got = {r.key: r for r in scan(spark.createDataFrame(files, "path string, key long, text string")).collect()}
    wrong = [(k, r.own_license) for k, r in got.items() if k < 9000 and r.own_license != TEMPLATES[k % 100][0]]
    assert not wrong
    assert got[9000].own_license == got[9001].license == got[9002].own_license == got[9003].license == "MIT"
