"""Passages of held-out items in a corpus, found by one automaton over the items' word sequences."""

from __future__ import annotations

import hashlib
import html
import pickle
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitloom.llm.bpe import text_of

#: Markup within a word joins what it parts; any other parts words.
_INLINE = regex.compile(r"</?(?:b|i|u|s|em|strong|span|a|font|sup|sub|small|mark|code)(?:\s[^<>]*)?/?>", regex.IGNORECASE)
_TAG = regex.compile(r"</?[A-Za-z][^<>]*>")
_TAG_OR_COMMENT = regex.compile(_TAG.pattern + r"|(?s:<!--.*?-->)")
_ENTITY = regex.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_UNSEEN = regex.compile(r"[\p{M}\p{Cf}]+")
#: A word is a run of letters and digits; of scripts that write no blanks, a single character. Hangul is written with blanks.
_WORD = regex.compile(r"[[\p{L}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}]]+|[\p{Han}\p{Hiragana}\p{Katakana}]", regex.V1)


#: The same for texts that are ASCII and in lower case.
_ASCII_WORD = re.compile("[a-z0-9]+")


def _split(plain: str) -> list[str]:
    return (_ASCII_WORD if plain.isascii() else _WORD).findall(plain)


def _plain(text: str) -> str:
    """Width, case, accents and invisible characters taken away."""
    if text.isascii():
        return text.lower()
    return _UNSEEN.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()))


def _markup(text: str) -> Iterator[regex.Match]:
    """Tags and comments of any length. Comments are looked for up to the last end of one, so that those without an end cost nothing."""
    end = text.rfind("-->") + 3
    if end >= 3:
        yield from _TAG_OR_COMMENT.finditer(text, 0, end)  # that end closes any tag, so none is cut
    yield from _TAG.finditer(text, end if end >= 3 else 0)


def _wordy_markup(text: str, least: int) -> bool:
    """Whether a tag that sets no attribute holds so many words: it may be text between two signs."""
    if "<" not in text:
        return False
    plain = _ENTITY.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text
    return any("=" not in m[0] and not m[0].startswith("<!") and len(_WORD.findall(m[0])) >= least for m in _markup(plain))


def words(text: str, markup: bool = True) -> list[str]:
    """The words of a text as they are compared; without ``markup`` its tags are text."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if markup and "<" in text:
        text, parts, last = _INLINE.sub("", text), [], 0
        for m in _markup(text):
            parts.append(text[last : m.start()])
            last = m.end()
        text = " ".join([*parts, text[last:]])
    return _split(_plain(text))


def placed_words(text: str, markup: bool = True) -> list[tuple[str, int, int]]:
    """The same words, each with its begin and end in the original text."""
    chars, at, last = [], [], 0
    for m in _ENTITY.finditer(text):
        chars += text[last : m.start()]
        at += [(k, k + 1) for k in range(last, m.start())]
        for c in html.unescape(m[0]):
            chars.append(c)
            at.append((m.start(), m.end()))
        last = m.end()
    chars += text[last:]
    at += [(k, k + 1) for k in range(last, len(text))]
    for find, by in ((_INLINE.finditer, ""), (_markup, " ")) if markup else ():
        joined, kept, where, last = "".join(chars), [], [], 0
        for m in find(joined):
            kept += chars[last : m.start()] + list(by)
            where += at[last : m.start()] + [(at[m.start()][0], at[m.end() - 1][1])] * len(by)
            last = m.end()
        chars, at = kept + chars[last:], where + at[last:]
    plain, where = [], []
    for c, p in zip(chars, at):
        # a mark is put in order among its neighbours, but it is dropped anyway: characters can be taken one by one
        for x in c.lower() if c < "\x80" else _plain(c):
            plain.append(x)
            where.append(p)
    return [(m[0], where[m.start()][0], where[m.end() - 1][1]) for m in _WORD.finditer("".join(plain))]


def longest_run(least: int, per_edit: int) -> int:
    """The words in a row without an edit that every passage has, with ``least`` words and one edit in ``per_edit`` at most.

    With e edits there are e + 1 runs, and as many words as the passage has, less the edits, to share among them.
    """
    runs = [least]
    for e in range(1, least + 1):
        n = max(least, per_edit * e)
        runs.append(-(-(n - e) // (e + 1)))
    return min(runs)


class Matcher:
    """Finds passages of items that a text holds.

    A passage has a run of ``longest_run`` words without an edit. Every second sequence of one word less of every item is a
    pattern of one Aho-Corasick automaton, so each such run holds a pattern and no passage is lost. Hits are brought to the
    beginning of their run, all at once; only from runs that are as long as a passage, or have an equal word again within
    ``_gap`` edits of an end, the alignment is extended to both sides, edit by edit, as far as it goes. Items of the same
    words are one.

    _gap: let all runs of a passage be shorter than ``least``, H of them hits whose gaps all have more than G edits, and N
    too short to be hits. With e edits their words are (per_edit - 1) * e at least and (least - 1) * H + (run - 1) * N at
    most, while e is (G + 1) * H + N - 1 at least, or (G + 1) * (H - 1) if N is 0: a contradiction for the G used here.
    """

    def __init__(self, items: list[tuple[int, str]], least: int = 14, per_edit: int = 10):
        self.least, self.per_edit = least, per_edit
        run = longest_run(least, per_edit)
        self.step = 2 if run > 2 else 1
        self.seed = run - self.step + 1
        if per_edit > run:
            self._gap = int(max((least - 1) / (per_edit - 1) + 1, 2 * (least - 1) / (per_edit - 1)))
        else:
            self._gap = max((len(words(t)) for _, t in items), default=0) // per_edit
        ids: dict[tuple[str, ...], list[int]] = {}
        for i, t in items:
            w = tuple(words(t))
            if len(w) >= least:
                ids.setdefault(w, []).append(i)
        self.items, self.ids = [list(w) for w in ids], list(ids.values())
        self.number: dict[str, int] = {}
        # all items in one row, with a gap between them that equals no word of a text
        between = [-1] * (self._gap + 2)
        flat, self.begins = [*between], []
        for w in self.items:
            self.begins.append(len(flat))
            flat += [self.number.setdefault(x, len(self.number)) for x in w] + between
        self.flat = np.array(flat, np.int32)
        patterns: dict[str, list[int]] = {}
        for w, at in zip(self.items, self.begins):
            for k in range(0, len(w) - self.seed + 1, self.step):
                patterns.setdefault(" " + " ".join(w[k : k + self.seed]) + " ", []).append(at + k)
        self.automaton = ahocorasick.Automaton()
        for p, places in patterns.items():
            self.automaton.add_word(p, (len(p), np.array(places, np.int32)))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def _runs(self, w: list[str], hits: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int]]:
        """(length, place in the items, word of the text) of each run of equal words that may be in a passage, longest first."""
        pad, flat = self._gap + 2, self.flat
        text = np.full(len(w) + 2 * pad, -2, np.int32)
        text[pad:-pad] = [self.number.get(x, -2) for x in w]
        p, q = np.concatenate([x for _, x in hits]).astype(np.int64), np.repeat([j + pad for j, _ in hits], [len(x) for _, x in hits])
        equal = lambda a, b: flat[a] == text[b]
        first = ~equal(p - 1, q - 1) if self.step == 1 else ~(equal(p - 1, q - 1) & equal(p - 2, q - 2))
        p, q = p[first], q[first]  # one hit a run; with every second word a pattern, the run may begin a word before
        back = equal(p - 1, q - 1).astype(np.int64)
        p, q = p - back, q - back
        n = np.full(len(p), self.seed, np.int64) + back
        going = np.arange(len(p))
        while len(going):
            going = going[equal(p[going] + n[going], q[going] + n[going])]
            n[going] += 1
        e, f, kept = p + n, q + n, n >= self.least
        for a in range(self._gap + 1):
            for b in range(self._gap + 1):
                if a or b:
                    kept |= equal(e + a, f + b) | equal(p - 1 - a, q - 1 - b)
                if a + b < self._gap:  # a word of the run itself, where the item has it again and the text has not
                    kept |= equal(e + a, f - 1 - b) | equal(p - 1 - a, q + b)
        kept = np.flatnonzero(kept)
        kept = kept[np.argsort(-n[kept], kind="stable")]
        return list(zip(n[kept].tolist(), p[kept].tolist(), (q[kept] - pad).tolist()))

    def _reach(self, a: list[str], b: list[str], edits: int) -> list[tuple[int, int]]:
        """For 0, 1, ... edits: the most words of ``a`` that align with a beginning of ``b`` and end on equal words."""

        def slide(x: int, y: int) -> int:
            while x < len(a) and y < len(b) and a[x] == b[y]:
                x, y = x + 1, y + 1
            return x

        x = slide(0, 0)
        front, best = {0: x}, [(x, x)]
        for _ in range(edits):
            grown = dict(front)
            for d, x in front.items():
                for to, begin in ((d, x + 1), (d - 1, x + 1), (d + 1, x)):  # altered, left out, put in
                    if begin <= len(a) and 0 <= begin + to <= len(b):
                        end = slide(begin, begin + to)
                        if end > grown.get(to, -1):
                            grown[to] = end
            front, top = grown, best[-1]
            for d, x in front.items():
                # what reaches a place reaches those before it on the diagonal; the last of them with equal words ends a passage
                while x > top[0] and x + d > 0 and a[x - 1] != b[x + d - 1]:
                    x -= 1
                if x > top[0] and x + d > 0:
                    top = (x, x + d)
            best.append(top)
        return best

    def passages(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, begin, end, words, edits) of the passage of each item with the most words less edits; offsets in code points.

        A text whose tag holds as many words as a passage is read with its tags as markup and as text.
        """
        if not text or self.empty:
            return []
        longest: dict[int, tuple[int, int, int, int]] = {}
        for markup in (True, False) if _wordy_markup(text, self.least) else (True,):
            found = self._found(words(text, markup))
            places = placed_words(text, markup) if found else []
            for k, (m, e, a, b) in found.items():
                for i in self.ids[k]:  # an item may have several texts, and a text several items
                    longest[i] = max((m, e, places[a][1], places[b - 1][2]), longest.get(i, (0, 0, 0, 0)))
        return [(i, begin, end, m - e, -e) for i, (m, e, begin, end) in sorted(longest.items())]

    def _found(self, w: list[str]) -> dict[int, tuple[int, int, int, int]]:
        """(words - edits, -edits, first word, word after the last) of the best passage of each item in the words of a text."""
        hits = list(self.automaton.iter(" " + " ".join(w) + " "))
        if not hits:
            return {}
        index, p = {}, 0
        for j, x in enumerate(w):
            index[p] = j
            p += len(x) + 1
        found: dict[int, tuple[int, int, int, int]] = {}
        for n, place, j in self._runs(w, [(index[end - length + 1], places) for end, (length, places) in hits]):
            i = bisect_right(self.begins, place) - 1
            item, best = self.items[i], found.get(i, (0, 0, 0, 0))
            if best[:2] == (len(item), 0):
                continue  # the whole item was found as it is
            k = place - self.begins[i]
            most = len(item) // self.per_edit
            window = len(item) + most + 1
            right = self._reach(item[k:], w[j : j + n + window], most)
            left = self._reach(item[: k + n][::-1], w[max(0, j - window) : j + n][::-1], most)
            for e1, (n1, m1) in enumerate(left):
                for e2, (n2, m2) in enumerate(right):  # both hold the run
                    size, e = n1 + n2 - n, e1 + e2
                    if size >= self.least and self.per_edit * e <= size and (size - e, -e) > best[:2]:
                        best = found[i] = (size - e, -e, j + n - m1, j + m2)
        return found


_matchers: dict[bytes, Matcher] = {}


def _matcher(packed: bytes) -> Matcher:
    key = hashlib.sha256(packed).digest()
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(*pickle.loads(packed))
    return _matchers[key]


def leaked_passages(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str,
    least: int = 14, per_edit: int = 10, block_chars: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, begin, end, words, edits): of each item that a document holds, the passage of the most words less edits.

    A passage is ``least`` words of an item or more, in one piece and in order, begins and ends with equal words, and has at
    most one word in ``per_edit`` altered, left out or put in; case, accents, punctuation, spacing, width, invisible
    characters, entities and markup do not count. ``begin`` and ``end`` are code point offsets in the document. Documents are
    read once in a narrow pass, whole. The items are sent to every worker, whose automaton takes some 120 MB a million
    characters; beyond ``block_chars`` characters they are taken in blocks, with a pass for each. Null and empty texts hold nothing, items of fewer than ``least`` words are never found;
    repeated documents are reported row by row, repeated items once, with the longest passage of any of their texts. Items
    without an id are left out.
    """
    spark = docs.sparkSession
    asked = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).distinct()
    chars = asked.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    kinds = [docs.schema[doc_id].dataType, items.schema[item_id].dataType]
    schema = T.StructType([T.StructField("doc_id", kinds[0]), T.StructField("item_id", kinds[1]), *(T.StructField(c, T.IntegerType()) for c in ("begin", "end", "words", "edits"))])
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).cast("binary").alias("t"))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else asked
        packed = spark.sparkContext.broadcast(pickle.dumps(([(r["i"], r["t"]) for r in own.collect()], least, per_edit)))

        def run(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(packed.value)
            for batch in batches:
                keys, rows = batch.column(0), []
                for k, raw in enumerate(batch.column(1)):
                    rows += ((k, *p) for p in matcher.passages(text_of(raw.as_py())))
                if rows:
                    k, *rest = zip(*rows)
                    columns = [keys.take(pa.array(k, pa.int32())), *(pa.array(c) for c in rest)]
                    arrow = pa.schema([("doc_id", keys.type), ("item_id", columns[1].type), *((c, pa.int32()) for c in ("begin", "end", "words", "edits"))])
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
