from itertools import product
from string import ascii_lowercase

from augury.llm import private


def test_crowded_names_and_formats_still_get_distinct_surrogates(make):
    given = ["".join(p).capitalize() for p in product("bdfgklmn", "aeiou", "bdfgklmnprst", "aeiou", "nr")]
    rows = [(i, f"Mr. {name} Smith") for i, name in enumerate(given)]
    rows += [(10_000 + i, f"{a}@{b}.com") for i, (a, b) in enumerate(product(ascii_lowercase, repeat=2))]
    rows += [(20_000, "password=--------"), (20_001, "token: ________")]
    got = {r["doc_id"]: r["text"] for r in private.replace_private(make(rows), "k").collect()}
    assert len(given) > 4112 and len(got) == len(set(got.values())) == len(rows)
    assert not set(got.values()) & {t for _, t in rows}
    assert all(t.startswith("Mr. ") and len(t.split(" ")) == 3 for d, t in got.items() if d < 10_000)
    assert all(t.endswith(".com") and t.count("@") == 1 for d, t in got.items() if 10_000 <= d < 20_000)
