"""Quality rules that clean line by line first and judge the document by what is left.

Punctuation, navigation and boilerplate rules are put to each line that has a word:

- punctuation: more marks than words can carry, or no letter or digit at all, or `PROSE_WORDS` words and more
  that neither hold nor end with a mark that ends a sentence or clause and that the next line doesn't continue;
- navigation: entries between separators, or one of `MENU_LINES` short lines in a row that end like no sentence;
- boilerplate: a short line with a phrase of notices, or one word over and over.

Lines that fail are removed, and a document is rejected if it loses too large a share of its characters, or
if it fails the base rules on its whole text (too few words, too many words in repeated windows).

Defined results: a null or empty text has zeros in all counts, fails the base rules for want of words and
has an empty cleaned text. Lines without a word are kept as they are and count for nothing. Texts are
taken whole. Repeated rows are judged alike; nothing but the text is read, so ids, other columns and ties
play no part, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .common import frees

#: Fixed values.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Share of a document's word characters that may stand in removed lines.
MAX_LOST = 0.5
#: A line of at most so many words is boilerplate if it has one of these phrases.
BOILERPLATE_WORDS = 30
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "cookies to",
    "javascript is disabled",
    "enable javascript",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "privacy policy",
    "sign up for",
    "subscribe to our",
    "click here",
    "read more",
    "log in to",
    "share this",
    "licensed under",
    "lorem ipsum",
    "copyright ©",
    "(c) copyright",
    "alle rechte vorbehalten",
    "cookie-richtlinie",
    "cookies zu",
    "bitte javascript",
    "javascript aktivieren",
    "nutzungsbedingungen",
    "allgemeine geschäftsbedingungen",
    "datenschutzerklärung",
    "newsletter abonnieren",
    "hier klicken",
    "weiterlesen",
    "jetzt anmelden",
    "tous droits réservés",
    "politique de cookies",
    "utilise des cookies",
    "activer javascript",
    "conditions d'utilisation",
    "conditions générales",
    "politique de confidentialité",
    "abonnez-vous",
    "cliquez ici",
    "lire la suite",
    "se connecter",
    "todos los derechos reservados",
    "política de cookies",
    "utiliza cookies",
    "activar javascript",
    "condiciones de uso",
    "términos y condiciones",
    "política de privacidad",
    "suscríbete a",
    "haga clic aquí",
    "leer más",
    "iniciar sesión",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
#: Words from which on a line may not repeat the word before it more often than not.
REPEAT_WORDS = 8
#: Words from which on a line is prose, and must end as prose does or go on in the next line.
PROSE_WORDS = 12
#: Lines of at most so many words are a menu if so many of them stand in a row.
MENU_WORDS = 4
MENU_LINES = 3
#: Marks that end a sentence or clause, also within quotes and brackets.
_ENDS = re.compile(r"[.!?:;,…。！？：；，]|[\"'”’»›)\]]$")
#: Words that are only marks between entries of a menu.
_SEPARATOR = re.compile(r"[|»«·•›‹>/\\–—-]+")
_MARKS = re.compile(r"[#*$%&|<>{}\[\]=~^_+@\\]")
_LOUD = re.compile(r"[!?#*$%&|<>=~^_+@]{2,}$")

FIELDS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
    "lost": pa.float64(),
    "n_lines": pa.int64(),
    "n_bad_lines": pa.int64(),
    "clean_text": pa.string(),
}


def line_fault(line: str, words: list[str], continued: bool = False) -> str | None:
    """The rule that a line with words fails by itself, or None. `continued`: the next line goes on with it."""
    n = len(words)
    separators = sum(1 for w in words if _SEPARATOR.fullmatch(w))
    if separators >= 3 and separators * 5 >= n or n >= 3 and separators * 2 >= n - 1 > 0:
        return "navigation"
    if n <= BOILERPLATE_WORDS and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    loud = sum(1 for w in words if _LOUD.search(w))
    if loud * 2 > n or len(_MARKS.findall(line)) * 4 > sum(map(len, words)):
        return "punctuation"
    if not any(c.isalnum() for c in line):
        return "punctuation"
    if n >= PROSE_WORDS and not continued and not _ENDS.search(line.rstrip()):
        return "punctuation"
    if n >= REPEAT_WORDS and sum(map(str.__eq__, words, words[1:])) * 2 > n:
        return "boilerplate"  # one word over and over
    return None


def _menu_lines(lines: list[str], words: list[list[str]]) -> set[int]:
    """Numbers of the short lines that stand in a row like the entries of a menu; empty lines don't count."""
    found: set[int] = set()
    row: list[int] = []
    for i, own in enumerate(words):
        if not own:
            continue
        if len(own) <= MENU_WORDS and not _ENDS.search(lines[i].rstrip()[-1:]):
            row.append(i)
            continue
        if len(row) >= MENU_LINES:
            found.update(row)
        row = []
    return found | set(row) if len(row) >= MENU_LINES else found


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of `WINDOW` words that the text holds twice or more, the first one included.

    Windows are told apart exactly: word numbers are paired into numbers for 2, 4 and 8 words.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    span = 1
    while span < WINDOW:
        paired = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        _, ids, counts = np.unique(paired, return_inverse=True, return_counts=True)
        if len(counts) == len(paired):
            return 0
        span *= 2
    starts = np.flatnonzero(counts[ids] > 1)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover[:n])))


def judge_text(text: str | None) -> tuple:
    """All result fields for one text."""
    text = text or ""
    words = text.encode().split()
    n_words = len(words)
    lines = text.split("\n")
    split = [[w.decode() for w in line.encode().split()] for line in lines]
    menu = _menu_lines(lines, split)
    # Whether the next line with words begins in lower case, for each line.
    continued, goes_on = [False] * len(lines), False
    for i in range(len(lines) - 1, -1, -1):
        continued[i] = goes_on
        goes_on = split[i][0][0].islower() if split[i] else goes_on
    seen: set[str] = set()
    good, n_lines, n_bad, dup, total, lost = [], 0, 0, 0, 0, 0
    for i, (line, own) in enumerate(zip(lines, split, strict=True)):
        if not own:
            good.append(line)
            continue
        n_lines += 1
        size = sum(map(len, own))
        total += size
        if line in seen:
            dup += 1
        seen.add(line)
        if i in menu or line_fault(line, own, continued[i]):
            n_bad += 1
            lost += size
        else:
            good.append(line)
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
    share = lost / total if total else 0.0
    kept = not failed and share <= MAX_LOST
    return n_words, total, symbols, dup, repeats, failed, kept, share, n_lines, n_bad, "\n".join(good)


def quality_rules(text: Column, fields: Iterable[str] | None = None) -> Column:
    """A struct of the rules' results for a text column; `fields` names those wanted (default: all)."""
    wanted = set(fields or FIELDS)
    chosen = [(i, n, kind) for i, (n, kind) in enumerate(FIELDS.items()) if n in wanted]
    struct = pa.struct([(n, kind) for _, n, kind in chosen])

    @F.arrow_udf(from_arrow_type(struct))
    @frees
    def judge(texts: pa.Array) -> pa.Array:
        rows = [judge_text(t.as_py()) for t in texts]
        columns = [pa.array([r[i] for r in rows], kind) for i, _, kind in chosen]
        return pa.StructArray.from_arrays(columns, fields=list(struct))

    return judge.asNondeterministic()(text)  # so that Catalyst doesn't evaluate it once for each use
