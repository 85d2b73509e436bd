"""Text analysis as columns: folding, analyzers, stop words, stemming, edit distance, wildcards."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of characters that are written without blanks between words.
CJK = "ᄀ-ᇿ⺀-⿟぀-ヿ㄀-㆏ㆠ-ㇿ㐀-䶿一-鿿ꥠ-꥿가-퟿豈-﫿\U00020000-\U0003134f"
CJK_PUNCTUATION = "　-〿＀-／：-＠［-｀｛-･‐-‧‰-⁞"
SPACE = r"\s\p{Zs}"
PUNCTUATION = r"!-/:-@\[-`{-~"

STOP_WORDS_ENGLISH = tuple(
    """a above after again all an and any are as at be because been before being below between both but by can could dare did do does
    during each either every few for from further had has have he her him his how i if in into is it its just may me might more most
    must my need neither no nor not of off on once only or other ought our out over own same shall she should so some such than that
    the their them then these they this those through to too under us used very was were what when where which while who whom will
    with would yet you your""".split()
)
#: Search words in their own right, so the default list leaves them out.
_NOT_DEFAULT = {"must", "you"}
STOP_WORDS_CHINESE = tuple("一 一个 上 不 也 了 人 会 你 到 去 和 在 好 就 很 我 是 有 没有 的 看 着 自己 要 说 这 都".split())
STOP_WORDS = tuple(w for w in STOP_WORDS_ENGLISH if w not in _NOT_DEFAULT) + STOP_WORDS_CHINESE

_IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")


def fold_string(text: str | None) -> str | None:
    """Compatibility case folding: NFKC, case fold, ignorable characters dropped."""
    if text is None:
        return None
    if text.isascii():
        return text.lower()
    folded = unicodedata.normalize("NFKC", text).casefold()
    return unicodedata.normalize("NFKC", _IGNORABLE.sub("", folded))


@F.pandas_udf(T.StringType())
def fold_full(text: pd.Series) -> pd.Series:
    """`fold_string` over Arrow batches."""
    return text.map(fold_string, na_action="ignore")


#: Texts of these characters alone fold by lower case and ß; all others leave the JVM.
_SIMPLE = "^[\\x00-\\x7fÀ-ÖØ-öø-ÿŒœ‘’“”–—]*$"


def fold(text: Column, full: bool = True) -> Column:
    """Compatibility case folding: in the JVM for Western European text, by `fold_full` for what has other characters.

    Without `full` all text is only lowered, with ß as ss.
    """
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    if not full:
        return plain
    simple = text.rlike(_SIMPLE)
    return F.when(simple, plain).otherwise(fold_full(F.when(~simple, text)))


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms with positions.

    whitespace: folded runs between white space, punctuation kept.
    ngram: runs of CJK give all n-grams of min_n..max_n characters, other runs are words; white space and
    punctuation part runs; all grams of a run share its position.
    Terms shorter than `min_token_length` and stop words are dropped, but positions still count them.
    `stemming` reduces terms afterwards.
    """

    kind: str = "ngram"
    min_n: int = 2
    max_n: int = 3
    min_token_length: int = 1
    stop_words: tuple[str, ...] = ()
    stemming: bool = False
    full_fold: bool = True

    def __post_init__(self):
        if self.kind not in REGISTRY:
            raise ValueError(f"unknown analyzer {self.kind!r}")
        if self.min_n < 1 or self.max_n < self.min_n:
            raise ValueError("need 1 <= min_n <= max_n")

    def tokens(self, text: Column) -> Column:
        """array<struct<term string, pos int>> of a text column; empty for null."""
        return F.coalesce(REGISTRY[self.kind](self, text), F.expr("cast(array() as array<struct<term:string,pos:int>>)"))

    def __call__(self, text: str) -> list[tuple[str, int]]:
        """Terms and positions of one string, for queries."""
        folded = fold_string(text) if self.full_fold else text.lower().replace("ß", "ss")
        out: list[tuple[str, int]] = []
        if self.kind == "whitespace":
            words = [w for w in re.split(r"\s+", folded) if w]
            out = [(w, i) for i, w in enumerate(words) if len(w) >= self.min_token_length]
        else:
            if self.kind == "jieba":
                out = [x for x in _jieba(self, folded) if len(x[0]) >= self.min_token_length and x[0] not in self.stop_words]
                return [(porter_stem(t), p) for t, p in out] if self.stemming else out
            run = re.compile(f"[{CJK}]+|[^\\s{CJK}{CJK_PUNCTUATION}{_PY_PUNCTUATION}]+")
            for i, m in enumerate(run.finditer(folded)):
                r = m[0]
                if re.match(f"[{CJK}]", r):
                    out += [(r[j : j + n], i) for n in range(self.min_n, self.max_n + 1) for j in range(len(r) - n + 1)]
                elif len(r) >= self.min_token_length:
                    out.append((r, i))
            out = [x for x in out if len(x[0]) >= self.min_token_length]
        out = [x for x in out if x[0] not in self.stop_words]
        return [(porter_stem(t), p) for t, p in out] if self.stemming else out


_PY_PUNCTUATION = r"!-/:-@\[-`{-~"


def _drop(a: Analyzer, tokens: Column) -> Column:
    if a.min_token_length > 1:
        tokens = F.filter(tokens, lambda t: F.length(t.term) >= a.min_token_length)
    if a.stop_words:
        tokens = F.filter(tokens, lambda t: ~t.term.isin(list(a.stop_words)))  # a set, looked up once a term
    return tokens


def _whitespace(a: Analyzer, text: Column) -> Column:
    words = F.filter(F.split(fold(text, a.full_fold), f"[{SPACE}]+"), lambda w: w != "")
    return _drop(a, F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("pos"))))


def _ngram(a: Analyzer, text: Column) -> Column:
    folded = fold(text, a.full_fold)
    runs = F.regexp_extract_all(folded, F.lit(f"([{CJK}]+|[^{SPACE}{CJK}{CJK_PUNCTUATION}{PUNCTUATION}]+)"), F.lit(1))

    def grams(run: Column) -> Column:
        size = F.length(run)
        each = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.flatten(F.array(*[each(n) for n in range(a.min_n, a.max_n + 1)]))

    terms = lambda run: F.when(run.rlike(f"^[{CJK}]"), grams(run)).otherwise(F.array(run))
    several = F.flatten(F.transform(runs, lambda run, i: F.transform(terms(run), lambda t: F.struct(t.alias("term"), i.alias("pos")))))
    # of a text without CJK characters every run is a term
    tokens = F.when(folded.rlike(f"[{CJK}]"), several).otherwise(F.transform(runs, lambda run, i: F.struct(run.alias("term"), i.alias("pos"))))
    return _drop(a, tokens)


_HAN = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f]+$")


def _jieba(a: Analyzer, folded: str) -> list[tuple[str, int]]:
    """Runs of Han characters are cut by the package of that name; other CJK runs, such as those with kana, give n-grams, as all
    do where the package is missing; other runs are words.  Every piece of a cut run has a position of its own."""
    try:
        import jieba
    except ImportError:
        jieba = None
    out: list[tuple[str, int]] = []
    pos = 0
    for m in re.finditer(f"[{CJK}]+|[^\\s{CJK}{CJK_PUNCTUATION}{_PY_PUNCTUATION}]+", folded):
        r = m[0]
        if not re.match(f"[{CJK}]", r):
            out.append((r, pos))
        elif jieba is not None and _HAN.match(r):
            pieces = [w for w in jieba.cut_for_search(r) if w.strip()]
            out += [(w, pos + i) for i, w in enumerate(pieces)]
            pos += max(0, len(pieces) - 1)
        else:
            out += [(r[j : j + n], pos) for n in range(a.min_n, a.max_n + 1) for j in range(len(r) - n + 1)]
        pos += 1
    return out


def _segmented(a: Analyzer, text: Column) -> Column:
    bare = replace(a, stop_words=(), min_token_length=1, stemming=False)

    @F.pandas_udf("array<struct<term:string,pos:int>>")
    def segment(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"term": t, "pos": p} for t, p in _jieba(bare, fold_string(x) if bare.full_fold else x.lower().replace("ß", "ss"))] if x else [])

    return _drop(a, segment(text))


def byte_offsets(text: str, terms: list[tuple[str, int]]) -> list[tuple[str, int, int, int]]:
    """(term, position, first byte, end byte) in the folded text of analysed terms, in order; grams of a run overlap."""
    folded, out, at, run = fold_string(text).encode(), [], 0, -1
    for term, pos in terms:
        raw = term.encode()
        i = folded.find(raw, at if pos != run else max(0, at))
        i = folded.find(raw) if i < 0 else i
        out.append((term, pos, i, i + len(raw)))
        at, run = (i + len(raw) if pos != run else i), pos
    return out


#: Analyzers by name; `register` adds further ones.
REGISTRY: dict[str, Callable[[Analyzer, Column], Column]] = {"whitespace": _whitespace, "ngram": _ngram, "jieba": _segmented}


def register(kind: str, tokens: Callable[[Analyzer, Column], Column]) -> None:
    REGISTRY[kind] = tokens


def unstemmed(a: Analyzer) -> Analyzer:
    return replace(a, stemming=False)


# -- stemming ---------------------------------------------------------------------------------------------


def _vowel(w: str, i: int) -> bool:
    c = w[i]
    return c in "aeiou" or (c == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    """Vowels of a stem, each of which counts, wherever it stands."""
    return sum(_vowel(w, i) for i in range(len(w)))


def _twin(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


_LONG = dict(
    [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("biliti", "ble"), ("alli", "al")]
    + [("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al")]
    + [("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("iciti", "ic")]
)
_MIDDLE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_LAST = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def porter_stem(word: str) -> str:
    """A suffix stemmer in eight steps for words of three or more letters a-z; others stay as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    w = word
    if len(w) >= 4 and w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss") and _measure(w[:-1]):
        w = w[:-1]
    cut = 2 if w.endswith("ed") and len(w) >= 3 else 3 if w.endswith("ing") and len(w) >= 4 else 0
    if cut and _measure(w[:-cut]):
        w = w[:-cut]
        if _twin(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif w.endswith(("at", "bl", "iz")):
            w += "e"
    if w.endswith("y") and len(w) > 1 and _measure(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_LONG, _MIDDLE):
        for end, new in rules.items():
            if w.endswith(end) and len(w) >= len(end) + 2 and _measure(w[: -len(end)]) > (end == "ful"):
                w = w[: -len(end)] + new
                break
    for end in _LAST:
        if w.endswith(end) and len(w) >= len(end) + 2 and _measure(w[: -len(end)]) > 1:
            w = w[: -len(end)]
            break
    if w.endswith("e") and len(w) > 1:
        stem, n = w[:-1], len(w) - 1
        closed = n >= 3 and not _vowel(stem, n - 1) and _vowel(stem, n - 2) and not _vowel(stem, n - 3) and stem[-1] not in "wxy"
        m = _measure(stem)
        if m > 1 or (m == 1 and not closed):
            w = stem
    if _measure(w) > 1 and _twin(w) and w[-1] not in "lsz":
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem(terms: pd.Series) -> pd.Series:
    """`porter_stem` over Arrow batches; apply it to distinct terms."""
    known = {t: porter_stem(t) for t in terms.dropna().unique()}
    return terms.map(known)


# -- patterns ---------------------------------------------------------------------------------------------


def as_bytes(text: Column | str) -> Column:
    """One character for each UTF-8 byte, so that string functions count bytes."""
    text = F.lit(text) if isinstance(text, str) else text
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def edit_distance_within(a: Column, b: Column, most: int) -> Column:
    """Whether the byte-level edit distance is at most `most`; lengths are compared first."""
    near = F.abs(F.octet_length(a) - F.octet_length(b)) <= most
    return near & (F.levenshtein(as_bytes(a), as_bytes(b), most) >= 0)


def wildcard_regex(pattern: str) -> str:
    """A whole-string expression: * is any run, ? is one byte, all else itself."""
    raw = pattern.encode().decode("latin-1")
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^\w])", r"\\\1", c) if ord(c) < 128 else c for c in raw) + "$"


def wildcard_match(term: Column, pattern: str) -> Column:
    """Whether a term matches; a literal beginning is compared first, which reaches the scan."""
    head = re.match(r"[^*?]*", pattern)[0]
    hit = as_bytes(term).rlike(wildcard_regex(pattern))
    return term.startswith(head) & hit if head else hit
