import math
import re
from collections import Counter
from pathlib import Path

import pytest

from augury.llm import licenses
from augury.llm.licenses import scan_licenses

NOTICE = "Copyright (c) 2019 Some Body"
FULL = {
    "MIT": f"MIT License\n\n{NOTICE}\n\n{licenses.MIT_GRANT}\n\n{licenses.MIT_REST}\n",
    "BSD-2-Clause": f"{NOTICE}\nAll rights reserved.\n\n{licenses.BSD_TERMS}\n\n{licenses.BSD_REST}\n",
    "BSD-3-Clause": f"{NOTICE}\n\n{licenses.BSD_TERMS}\n\n{licenses.BSD_NAME}\n\n{licenses.BSD_REST}\n",
    "ISC": f"ISC License\n\n{NOTICE}\n\n{licenses.ISC_GRANT}\n\n{licenses.ISC_REST}\n",
    "Apache-2.0": licenses.APACHE_OPENING + "\n\n" + "other terms of the work " * 200,
    "CC-BY-SA-4.0": licenses.CC_TITLE.format(name="Attribution-ShareAlike") + "\n\nBy exercising the rights you accept.",
    "MPL-2.0": licenses.MPL_OPENING + "\n\n" + "other terms of the work " * 200,
}


def wrapped(text, mark):
    return "\n".join(f"{mark} {line}" for line in text.split("\n")) + "\nint main() { return 0; }\n" + "code();\n" * 30


def named(spark, rows):
    files = spark.createDataFrame(rows, "path string, text string")
    return {r["path"]: (r["license"], r["origin"]) for r in scan_licenses(files).collect()}


def test_licence_files_and_wrapped_headers(spark):
    rows = [(f"f{i}/LICENSE", t) for i, t in enumerate(FULL.values())] + [(f"f{i}/src/main.c", "int x;") for i in range(len(FULL))]
    headers = {"MIT": FULL["MIT"], "BSD-3-Clause": FULL["BSD-3-Clause"], "MPL-2.0": licenses.MPL_HEADER,
               "Apache-2.0": licenses.APACHE_HEADER + "\n\n" + licenses.APACHE_REST, "GPL-2.0": licenses._gnu("General Public License", "2")[1],
               "GPL-3.0": licenses._gnu("General Public License", "3")[1], "LGPL-2.1": licenses._gnu("Lesser General Public License", "2.1")[1]}
    rows += [(f"h{i}/a.c", wrapped(t, "//" if i % 2 else "#")) for i, t in enumerate(headers.values())]
    rows += [(f"h{i}/b.c", "int y;") for i in range(len(headers))]
    rows += [("n/a.txt", "We talk of copyright and of a licence to drive.\n\nFree software is nice, they say.")]
    got = named(spark, rows)
    for i, licence in enumerate(FULL):
        assert got[f"f{i}/LICENSE"] == (licence, "own") and got[f"f{i}/src/main.c"] == (licence, "inherited"), licence
    for i, licence in enumerate(headers):
        assert got[f"h{i}/a.c"] == (licence, "own") and got[f"h{i}/b.c"] == (licence, "inherited"), licence
    assert got["n/a.txt"] == (None, None)


COMMON = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts on this machine")
def test_long_licences_as_published(spark):
    known = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    rows = [(f"{name}/COPYING", (COMMON / name).read_text()) for name in known if (COMMON / name).exists()]
    got = named(spark, rows)
    assert {path.split("/")[0]: licence for path, (licence, _) in got.items()} == {path.split("/")[0]: known[path.split("/")[0]] for path, _ in rows}


def test_ties_long_texts_and_one_hot_folder(spark):
    long_text = "no cue here " * 200_000 + "\n\n" + licenses.MIT_GRANT
    rows = [("t/LICENSE", "Released under the MIT License."), ("t/COPYING", "Released under the MIT License."), ("t/x.c", "x"), ("l/a.txt", long_text)]
    rows += [(f"t/{i}.c", "x") for i in range(3000)]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r["path"]: r for r in scan_licenses(files).collect()}
    assert got["t/x.c"]["declared_by"] == "t/COPYING" and got["l/a.txt"]["license"] == "MIT"
    assert all(got[f"t/{i}.c"]["license"] == "MIT" for i in range(3000))


def test_scores_against_brute_force(spark):
    texts = ["Released under the MIT License.\nplain", licenses.APACHE_HEADER, "// copyright me\n// " + licenses.MPL_HEADER.replace("\n", "\n// ") + "\nx"]
    got = {r["path"]: r["score"] for r in scan_licenses(spark.createDataFrame([(f"d{i}/a", t) for i, t in enumerate(texts)], "path string, text string")).collect()}
    every = []
    for t in texts:
        plain = "\n".join(re.sub(r"^[ \t]*(?://+|#+|/?\*+/?|--+|;+|<!--)?[ \t]*", "", line).rstrip(" \t\r") for line in t.split("\n"))
        lead = []
        for line in t.split("\n"):
            if re.match(r"[ \t\r]*[^ \t\r\n/#*;<\-]", line):
                break
            lead.append(re.sub(r"^[ \t]*(?://+)?[ \t]*", "", line))
        parts = [("line", x) for x in t.split("\n")] + [("block", x) for x in re.split("\n{2,}", plain)] + [("block", "\n".join(lead)), ("block", plain)]
        every.append([(k, x) for k, x in parts if re.search(licenses.CUE, x)])
    bags = [Counter(re.findall(licenses.WORD, x.lower())) for parts in every for _, x in parts]
    df = Counter(w for b in bags for w in b)

    def vector(bag):
        return {w: n * (math.log((len(bags) + 1) / (df[w] + 1)) + 1) for w, n in bag.items()}

    def cosine(a, b):
        return sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    models = [vector(Counter(re.findall(licenses.WORD, t.lower()))) for ts in licenses.TEMPLATES.values() for t in ts]
    for i, parts in enumerate(every):
        scores = [(k, max(cosine(vector(Counter(re.findall(licenses.WORD, x.lower()))), m) for m in models)) for k, x in parts]
        assert abs(got[f"d{i}/a"] - max(s for k, s in scores if s >= (0.6 if k == "line" else 0.75))) < 2e-6
