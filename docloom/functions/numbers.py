"""Numbers in words: written as Column expressions, read back by a grammar over symbols.

Every word of a text becomes one symbol (a unit, a ten, a scale, ...), a regular expression over the
symbols finds the longest runs that state a number, and a run's value follows from its symbols.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vocabulary as V

# --- writing -------------------------------------------------------------------------------------


def english(value: str) -> Column:
    """English words of a column of whole numbers below a thousand million."""
    v = F.col(value)
    pick = lambda words, k: F.get(F.array(*[F.lit(w) for w in words]), k.cast("int"))

    def below_hundred(n: Column) -> Column:
        tens = F.concat(pick(V.EN_TENS, F.floor(n / 10) - 2), F.when(n % 10 > 0, F.concat(F.lit("-"), pick(V.EN_SMALL, n % 10))).otherwise(""))
        return F.when(n < 20, pick(V.EN_SMALL, n)).otherwise(tens)

    def below_thousand(n: Column) -> Column:
        hundreds = F.when(n >= 100, F.concat(pick(V.EN_SMALL, F.floor(n / 100)), F.lit(" hundred")))
        return F.concat_ws(" ", hundreds, F.when(n % 100 > 0, below_hundred(n % 100)))

    parts = [(F.floor(v / 1_000_000) % 1000, " million"), (F.floor(v / 1000) % 1000, " thousand"), (v % 1000, "")]
    words = F.concat_ws(" ", *[F.when(n > 0, F.concat(below_thousand(n), F.lit(scale))) for n, scale in parts])
    return F.when(v == 0, "zero").otherwise(words)


# --- reading -------------------------------------------------------------------------------------

#: One symbol a word. Arabic: U unit, T ten (or teen after a unit), M teen, X tens, H hundred, G several
#: hundreds, D a scale that counts itself, S scale, Z two of a unit, w "and". English: s small, o one, c
#: hundred, k scale, a "and".
_ARABIC = (
    {w: ("U", n) for w, n in V.AR_UNITS.items()}
    | {"عشره": ("T", 10), "عشر": ("M", 10)}
    | {w: ("X", n) for w, n in V.AR_TENS.items()}
    | {w: ("H", 100) for w in V.AR_HUNDRED}
    | {w: ("G", 200) for w in V.AR_TWO_HUNDRED}
    | {u + h: ("G", V.AR_UNITS[u] * 100) for u in ("ثلاث", "اربع", "خمس", "ست", "سبع", "ثمان", "ثماني", "تسع") for h in V.AR_HUNDRED}
    | {w: ("S", n) for w, n in V.AR_SCALES.items()}
    | {w: ("D", n) for w, n in V.AR_SCALE_DUALS.items()}
)
_ENGLISH = (
    {w: ("s", n) for n, w in enumerate(V.EN_SMALL) if w != "one"}
    | {w: ("s", 10 * n) for n, w in enumerate(V.EN_TENS, 2)}
    | {"one": ("o", 1), "hundred": ("c", 100), "and": ("a", 0)}
    | {w: ("k", n) for w, n in V.EN_SCALES.items()}
)
_ITEM = "(?:U[TM]|UH|[UTXHGDS])"
_RUN = re.compile(rf"Z|{_ITEM}(?:w?{_ITEM})*|(?:s|o(?=[ck]))(?:s|o(?=[ck])|c|k|a(?=s))*")
_WORD = re.compile(r"[\w؀-ۿ]+(?:-[a-z]+)?")


def _symbol(word: str) -> tuple[str, int]:
    if word in V.AR_UNIT_DUALS:
        return "Z", 2
    if word == "و":
        return "w", 0
    for prefix in ("", "وال", "و", "ال", "بال", "لل"):
        if word.startswith(prefix) and word[len(prefix) :] in _ARABIC:
            return _ARABIC[word[len(prefix) :]]
    both = [_ENGLISH.get(p, ("", 0)) for p in word.split("-")]
    if len(both) == 2 and both[0][0] == both[1][0] == "s":
        return "s", both[0][1] + both[1][1]
    return _ENGLISH.get(word, (".", 0))


def _value(symbols: str, values: list[int]) -> int:
    total = now = 0
    for k, (s, v) in enumerate(zip(symbols, values)):
        if s == "S" or s == "k":
            total, now = total + (now or 1) * v, 0
        elif s == "D":
            total, now = total + now + v, 0
        elif s == "c":
            now = (now or 1) * 100
        elif s == "H" and k and symbols[k - 1] == "U":
            now += values[k - 1] * 100 - values[k - 1]
        else:
            now += v
    return total + now


def normal(text: str) -> str:
    return T.fold(unicodedata.normalize("NFKC", text))


def found(text: str) -> list[tuple[int, int, int]]:
    """(value, start, end) of every number that normalised text states in words."""
    places = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
    known = [_symbol(w) for w, _, _ in places]
    symbols, out, at = "".join(s for s, _ in known), [], 0
    while m := _RUN.search(symbols, at):
        a, b = m.span()
        word = places[a][0]
        weak = b - a == 1 and (any(word.endswith(w) for w in V.AR_WEAK if word in (w, "و" + w, "ال" + w, "وال" + w, "بال" + w, "لل" + w)) or symbols[a] == "M")
        at = b
        if not weak:
            out.append((_value(symbols[a:b], [v for _, v in known[a:b]]), places[a][1], places[b - 1][2]))
    return out


def spelled(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, value, digit_forms, with_digits``: the first number that a text states in words, all of them
    as digits (with and without separators), and the normalised text with digits in their places."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                norm = normal(t or "")
                numbers, at, parts = found(norm), 0, []
                for value, start, end in numbers:
                    parts += [norm[at:start], str(value)]
                    at = end
                forms = dict.fromkeys(x for v, _, _ in numbers for x in (str(v), *([f"{v:,}"] if v >= 1000 else [])))
                rows.append((k, numbers[0][0] if numbers else None, " ".join(forms), "".join([*parts, norm[at:]])))
            yield pd.DataFrame(rows, columns=[key, "value", "digit_forms", "with_digits"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, value long, digit_forms string, with_digits string")
