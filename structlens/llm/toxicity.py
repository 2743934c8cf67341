"""Scoring texts for abusive, hateful and sexually explicit clauses with a weighted finite-state grammar.

Transducers are composed on the fly. The first folds spelling: character
escapes, markup, accents, look-alike letters, digits and signs for letters,
letters set apart, drawn out, swapped or starred out become plain words. The
lexicon transducer maps words and phrases to weighted classes (strong and mild
insults, foul adjectives, targets, groups, body parts, violence, ...). The clause
transducers read classes: insult, threat, hate and sex patterns take their
target (the reader, a user, a group, a body part) along their path and add up
its weight; negation, own play, teasing, game pieces, titles and talk about
moderation are read by further transducers whose weights are taken from the
categories in their scope. A clause's weight per category is that of its best
path less what is taken away, and it counts from 1 on; a text's score is its
strongest clause's.

Texts are read whole, in the task that holds them; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlens.llm.automata import Lexicon, Machine, Pattern
from structlens.llm.toxicity_lexicon import CLASSES, COMMON, GUARDS, PATTERNS
from structlens.storage import spread

CATEGORIES = ("insult", "threat", "hate", "sexual")
THRESHOLD = 1.0

_INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_CONTROL = re.compile("[\x00-\x08\x0b-\x1f\x7f\x80-\x9f]")
_MOJIBAKE = re.compile("[ÂÃ][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-‚“-„†-•…‰‹›€™]")
_TAG = re.compile(r"""</?[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z_:][\w:.-]*(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+))?)*\s*/?>""")
_MARKS = re.compile("[\u0300-\u036f]")
#: Look-alike letters, folded after lower-casing.
_ALIKE = str.maketrans("аеорсухіѕјԁһкмнтвгοαειρτυκ", "aeopcyxisjdhkmhtbroaeiptuk")
_LEET = str.maketrans("013457$@!8|+", "oieastsaibit")
_LEET_L = str.maketrans("013457$@!8|+", "oleastsalblt")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_] ){3,}[^\W_](?![^\W_])")
#: What every match of the two around it holds; found faster.
_LONE = re.compile(r" [^\W_] [^\W_] ")
_APART = re.compile(r"[._\-*].[._\-*]")
_DOTTED = re.compile(r"(?<![^\s\"'(>*])(?:[^\W_@]|[@$!])(?:[._\-*][^\W_@]|[._\-*][@$!]){2,}[._\-*]?(?=[^\w@$]|$)")
_NUMBERED = re.compile(r"@?(?<!\w)\w+_\d+\b")
_HANDLE = re.compile(r"@?[^\W\d_]{3,}_\d+")
_AT = re.compile(r"(?<![\w@])@\w[\w.]*\b")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+|\.{3,}")
_CLEAN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_RUN3 = re.compile(r"(.)\1{2,}")


LEXICON = Lexicon(CLASSES)
MACHINE = Machine([Pattern((category,), text) for category, text in PATTERNS] + [Pattern(tuple(categories.split()), text, weight) for categories, weight, text in GUARDS])
_COMMON = frozenset(COMMON.split())


def _class_words(name: str) -> frozenset[str]:
    """The words of a class, or a word itself; of a phrase one word, which no match can do without."""
    if name not in CLASSES:
        return frozenset((name,)) - {"END", "_"}
    entries = [e.split(":")[0].split("-") for e in CLASSES[name][1].split()]
    return frozenset(min(parts, key=lambda w: (w in _COMMON, -len(w))) for parts in entries)


def _words_of(names: tuple[str, ...]) -> frozenset[str]:
    return frozenset(w for n in names for e in CLASSES[n][1].split() for w in e.split(":")[0].split("-") if len(w) > 1)


#: Every word the grammar knows.
WORDS = frozenset(w for w in LEXICON.vocabulary() | {x for x in MACHINE.labels() if x.islower() and x != "_"} if len(w) > 1)
#: Words that carry a verdict; where a starred-out word fits several, these come first.
TELLING = _words_of(("STRONG", "MILD", "WASTE", "PART", "LEWD", "ACT", "GROUP", "DEHUMAN", "NAMECALL", "FOUL", "HURT", "BODY")) - _COMMON
#: Short words whose misspellings are looked for all the same.
_CURSES = frozenset(w for w in _words_of(("DISMISS", "DEATH", "SHIT", "FUCK")) if len(w) == 4) - frozenset("your that mich fuck".split()) | {"fuck", "geil"}


def _triggers() -> frozenset[str]:
    """Words of which every match of a pattern holds one: of each pattern, those of its least common required element."""
    out: set[str] = set()
    for category, text in PATTERNS:
        best: frozenset[str] | None = None
        for labels, optional, _ in MACHINE._elements(text.removeprefix("^")):
            if optional:
                continue
            words = frozenset(w for name, _ in labels for w in _class_words(name))
            if words and (best is None or (len(words & _COMMON), len(words)) < (len(best & _COMMON), len(best))):
                best = words
        out |= best or set()
    return frozenset(out)


TRIGGERS = _triggers()
#: Plain words that a swap of neighbouring letters must not be taken for.
_PLAIN = frozenset("crate crates lasts late rase arts ares form from trial trail unite untie quite quiet sign sing dairy diary angle angel bale able trap part lair liar lied idle tried tired".split())


def _swaps() -> dict[str, str]:
    """Neighbouring letters swapped in words of five letters or more."""
    out: dict[str, str] = {}
    for w in sorted(WORDS):
        if len(w) >= 5 or len(w) == 4 and (w in TELLING or w in _CURSES):
            for i in range(len(w) - 1):
                swapped = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
                if swapped not in WORDS and swapped not in _PLAIN:
                    out.setdefault(swapped, w)
    return out


SWAPS = _swaps()
_BY_LENGTH: dict[int, list[str]] = {}
for _w in sorted(WORDS, key=lambda w: (w not in TELLING, w)):
    _BY_LENGTH.setdefault(len(_w), []).append(_w)


def _known(token: str) -> str | None:
    if token in WORDS:
        return token
    if "v" in token and token.replace("v", "u") in WORDS:
        return token.replace("v", "u")
    if not _RUN3.search(token):
        return SWAPS.get(token)
    for fewer in (_RUN3.sub(r"\1\1", token), _RUN3.sub(r"\1", token)):
        if fewer in WORDS:
            return fewer
    return SWAPS.get(token) or SWAPS.get(_RUN3.sub(r"\1", token))


def unfold(chunk: str) -> tuple[str, ...]:
    """The plain words behind one blank-separated chunk of folded text."""
    if chunk.isalpha():
        return (_known(chunk) or chunk,)
    core = chunk.strip("\"'()[]{}<>,;:.?¿¡…“”„‘’«»`~")
    if not core:
        return ()
    bare = core.rstrip("!")
    if bare.isalpha():
        return (_known(bare) or bare,)
    if not any(c.isalpha() for c in bare):
        return ()
    for candidate in (bare, core):
        for table in (_LEET, _LEET_L):
            plain = candidate.translate(table)
            if plain.isalpha() and (known := _known(plain)):
                return (known,)
    if re.search(r"[#*\-]", bare):
        wild = _RUN3.sub(r"\1", bare.translate(_LEET).replace("#", "*").replace("-", "*"))
        if re.fullmatch(r"[a-z*]+", wild) and wild.count("*") * 2 < len(wild) and len(wild) > 2:
            shape = re.compile(wild.replace("*", "[a-z]"))
            for w in _BY_LENGTH.get(len(wild), ()):
                if shape.fullmatch(w):
                    return (w,)
    plain = bare.translate(_LEET)
    if plain.isalpha():
        return (plain,)
    parts = [p.translate(_LEET) if any(c.isalpha() for c in p) else p for p in _CLEAN.findall(bare.replace("’", "'").replace("'", " "))]
    return tuple(_known(p) or p for p in parts if any(c.isalpha() for c in p))


def _handle(found: re.Match) -> str:
    """A word of three letters or more, an underscore and a number is a user, with or without a sign before it."""
    return " user " if _HANDLE.fullmatch(found[0]) else found[0]


def fold(text: str) -> str:
    """Lower case, markup and escapes resolved, invisible characters and accents gone, look-alikes and set-apart letters joined."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "Ã" in text or "Â" in text:
        text = _MOJIBAKE.sub(lambda m: m[0].encode("cp1252", "ignore").decode("utf8", "ignore") if m[0][1] > "\u009f" else m[0].encode("latin1", "ignore").decode("utf8", "ignore"), text)
    text = _TAG.sub("\n", text)
    text = _CONTROL.sub(" ", _INVISIBLE.sub("", text.replace("\r", "\n")))
    if "_" in text:
        text = _NUMBERED.sub(_handle, text)
    if "@" in text:
        text = _AT.sub(" user ", text)
    text = text.casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(_ALIKE)
    if _LONE.search(text):
        text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    return _DOTTED.sub(lambda m: re.sub(r"[._\-*]", "", m[0]), text) if _APART.search(text) else text


class _Chunks(dict):
    """Chunk of folded text -> (its plain words, a comma if it ends in one; whether one of them sets the patterns to work)."""

    #: Chunks remembered.
    MOST = 300_000

    def __missing__(self, chunk: str) -> tuple[tuple[str, ...], bool]:
        words = unfold(chunk)
        told = not TRIGGERS.isdisjoint(words)
        if chunk[-1] in ",;:":
            words = (*words, ",")
        if len(self) >= self.MOST:
            self.clear()
        self[chunk] = words, told
        return words, told


_CHUNKS = _Chunks()


def clauses(text: str) -> Iterator[tuple[str, ...]]:
    """The plain words, commas kept apart, of those sentences of a text that hold a word which sets the patterns to work."""
    for sentence in _SENTENCE.split(fold(text)):
        found = [_CHUNKS[chunk] for chunk in sentence.split()]
        if any(told for _, told in found):
            words: list[str] = []
            for part, _ in found:
                words += part[:-1] if part and part[-1] == "," and (words[-1:] == [","] and len(part) == 1) else part
            if words and words[-1] == ",":
                words.pop()
            yield tuple(words)


@lru_cache(maxsize=100_000)
def score_clause(clause: tuple[str, ...]) -> tuple[float, ...]:
    """Weight per category of one clause."""
    found = MACHINE.run(LEXICON.read(clause))
    best, less = dict.fromkeys(CATEGORIES, 0.0), dict.fromkeys(CATEGORIES, 0.0)
    for number, weight in found.items():
        pattern = MACHINE.patterns[number]
        for category in pattern.counts_for:
            if pattern.weight:
                less[category] += pattern.weight
            elif weight > best[category]:
                best[category] = weight
    return tuple(round(max(0.0, best[c] + less[c]), 4) for c in CATEGORIES)


def score_text(text: str | None) -> tuple[float, ...]:
    """Per category the weight of the strongest clause, and last the number of clauses that count."""
    best, count = [0.0] * len(CATEGORIES), 0
    for clause in clauses(text or ""):
        scores = score_clause(clause)
        if max(scores) >= THRESHOLD:
            count += 1
            best = [max(a, b) for a, b in zip(best, scores, strict=True)]
    return (*best, count)


def toxicity_scores(df: DataFrame, keep: dict[str, Column], text: str) -> DataFrame:
    """The kept columns, insult, threat, hate, sexual, score (their maximum) and clauses that count, of every row.

    Defined cases: null and empty texts score 0; rows are scored one by one, so
    repeated rows score alike; quoted text counts as text; an empty table gives
    no row; other columns are not read.
    """
    slim = spread(df.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("_text")))
    names = list(keep)
    width = len(names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [score_text(t.as_py()) for t in batch.column(width)]
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(CATEGORIES))]
            top = pa.array([max(r[: len(CATEGORIES)]) for r in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width)], *columns, top, pa.array([r[-1] for r in rows], pa.int32())], names=[*names, *CATEGORIES, "score", "clauses"])

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text")
    return slim.mapInArrow(score, f"{typed}, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", score double, clauses int")
