"""Text expressions: team keys, status words, label families, token signs, spreadsheet-safe cells."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# League spellings and the key they share.
SOCCER_ALIASES = {
    "afc-bournemouth": "bournemouth",
    "brighton-hove-albion": "brighton",
    "brighton-and-hove-albion": "brighton",
    "ipswich-town": "ipswich",
    "leeds-united": "leeds",
    "leicester-city": "leicester",
    "luton-town": "luton",
    "manchester-city": "man-city",
    "manchester-united": "man-united",
    "newcastle-united": "newcastle",
    "nottingham-forest": "nottm-forest",
    "nott-m-forest": "nottm-forest",
    "sheffield-united": "sheffield-utd",
    "tottenham-hotspur": "tottenham",
    "west-ham-united": "west-ham",
    "wolverhampton-wanderers": "wolves",
}

# Baseball abbreviations and the key they stand for.
BASEBALL_ALIASES = {
    "ari": "arizona-diamondbacks", "az": "arizona-diamondbacks", "atl": "atlanta-braves", "bal": "baltimore-orioles",
    "bos": "boston-red-sox", "chc": "chicago-cubs", "chw": "chicago-white-sox", "cws": "chicago-white-sox",
    "cin": "cincinnati-reds", "cle": "cleveland-guardians", "col": "colorado-rockies", "det": "detroit-tigers",
    "hou": "houston-astros", "kc": "kansas-city-royals", "kcr": "kansas-city-royals", "laa": "los-angeles-angels",
    "ana": "los-angeles-angels", "lad": "los-angeles-dodgers", "mia": "miami-marlins", "mil": "milwaukee-brewers",
    "min": "minnesota-twins", "nym": "new-york-mets", "nyy": "new-york-yankees", "ath": "athletics",
    "oak": "athletics", "phi": "philadelphia-phillies", "pit": "pittsburgh-pirates", "sd": "san-diego-padres",
    "sdp": "san-diego-padres", "sf": "san-francisco-giants", "sfg": "san-francisco-giants",
    "sea": "seattle-mariners", "stl": "st-louis-cardinals", "tb": "tampa-bay-rays", "tbr": "tampa-bay-rays",
    "tex": "texas-rangers", "tor": "toronto-blue-jays", "wsh": "washington-nationals", "was": "washington-nationals",
}


def _ascii_folds() -> tuple[str, str, dict[str, str]]:
    """Derive from all of Unicode which characters decompose to one ASCII character and which to several."""
    single, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        folded = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            single[chr(code)] = folded
        elif folded:
            several[chr(code)] = folded
    return "".join(single), "".join(single.values()), several


_FOLD_FROM, _FOLD_TO, _FOLD_SEVERAL = _ascii_folds()
_SEVERAL_PATTERN = "[" + "".join(_FOLD_SEVERAL) + "]"


def _once(value: Column, use) -> Column:
    """Apply ``use`` to ``value`` without repeating its expression.

    Text keys are used two or three times each; repeating them makes generated methods too large for the JIT.
    """
    return F.get(F.transform(F.array(value), use), 0)


def ascii_fold(text: Column) -> Column:
    """Compatibility-decompose to ASCII and drop what has no ASCII form. Every Unicode code point is covered."""
    # One literal, folded to a map once; both separators are ASCII and so never a key.
    several = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in _FOLD_SEVERAL.items())), F.lit("\x02"), F.lit("\x01"))

    def spelled(value: Column) -> Column:
        return F.array_join(F.transform(F.split(value, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")

    folded = F.translate(text, _FOLD_FROM, _FOLD_TO)
    expanded = _once(folded, lambda v: F.when(v.rlike(_SEVERAL_PATTERN), spelled(v)).otherwise(v))
    return F.regexp_replace(expanded, r"[^\x00-\x7F]", "")


def _lookup(values: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def _hyphenate(text: Column, pattern: str) -> Column:
    return F.btrim(F.regexp_replace(text, pattern, "-"), F.lit("-"))


def team_key(name: Column, sport: Column) -> Column:
    """Schedule-source key: folded, lower case, '&' spelled out, runs of other characters become '-'."""
    text = F.replace(F.replace(F.lower(ascii_fold(name)), F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(" "))
    slug = _hyphenate(text, "[^a-z0-9]+")
    return _once(slug, lambda s: F.when(sport == "soccer", _lookup(SOCCER_ALIASES, s)).otherwise(s))


def book_team_key(name: Column) -> Column:
    """Price-source key: letters and digits of any script kept, abbreviations expanded; null when empty."""
    text = F.replace(F.lower(F.trim(name)), F.lit("&"), F.lit(" and "))
    slug = _hyphenate(text, r"[^\p{L}\p{N}]+")
    return _once(slug, lambda s: F.when(s != "", _lookup(BASEBALL_ALIASES, s)))


def _first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    head, *tail = rules
    out = F.when(head[0], head[1])
    for condition, value in tail:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def scoreboard_status(words: list[Column], completed: Column, state: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *words))
    return _first_match([(text.contains("postpon"), "postponed"), (text.contains("cancel"), "cancelled"),
                         (F.coalesce(completed, F.lit(False)) | F.coalesce(state == "post", F.lit(False)), "final"),
                         (state == "in", "live")], "scheduled")


def schedule_status(abstract: Column, detailed: Column) -> Column:
    text = F.lower(F.concat_ws(" ", abstract, detailed))
    return _first_match([(text.contains("postpon"), "postponed"), (text.contains("cancel"), "cancelled"),
                         (text.contains("final") | text.contains("completed"), "final"),
                         ((abstract == "Live") | text.contains("progress") | text.contains("warmup"), "live")],
                        "scheduled")


def label_family(label: Column, prefixes: list[tuple[str, str]], other: str = "other") -> Column:
    return _first_match([(label.startswith(p), name) for p, name in prefixes], other)


def category(rules: list[tuple[Column, str]], other: str) -> Column:
    """First matching category; conditions are tried in order."""
    return _first_match([(F.coalesce(c, F.lit(False)), n) for c, n in rules], other)


def tokens(text: Column) -> Column:
    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), ","), lambda t: F.trim(t))


# Transmitter words that carry a fast sign.
POSITIVE_TOKENS = ["acetylcholine"]
NEGATIVE_TOKENS = ["gaba", "glutamate", "histamine"]


def token_sign(text: Column) -> tuple[Column, Column]:
    """(sign, uncertain): the sign is negative only when it alone is named; mixed or unknown is +1 and flagged."""
    words = tokens(text)
    plus = F.arrays_overlap(words, F.array(*[F.lit(t) for t in POSITIVE_TOKENS]))
    minus = F.arrays_overlap(words, F.array(*[F.lit(t) for t in NEGATIVE_TOKENS]))
    return F.when(minus & ~plus, -1).otherwise(1), plus == minus


def only_tokens(text: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(tokens(text), F.array(*[F.lit(t) for t in allowed]))) == 0


def spreadsheet_safe(cell: Column) -> Column:
    """Prefix a quote when a spreadsheet would read the cell as a formula."""
    return F.when(cell.rlike(r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]*[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)
