"""Cut texts into units that tokenizers treat on their own, a column at a time.

A unit is a word with the space before it, a word at the start of a line, or a
run of line breaks. Arrow's kernels split the column and number its distinct
words; only those ever become Python strings. A store keeps what was computed
for a unit, so that each process works it out once; the store is bounded, and
units beyond the bound are worked out again in each batch.

Only texts whose white space is single spaces between visible characters and
line breaks beside them are cut; :class:`Cut` names the others, which callers
treat whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# white space and separators other than the space and the line break
_ODD = r"[\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TRAILING = "\n "  # a trailing run of k line breaks is the unit "\n" * (k - 1) + TRAILING


class UnitTable:
    """Rows of numbers and Python objects by unit. ``work(units)`` gives, for
    new units, a dict of columns: a list, or a pair (lengths, flat array)."""

    def __init__(self, work: Callable, bound: int):
        self.work, self.bound = work, bound
        self.code: dict[str, int] = {}
        self.lists: dict[str, list] = {}
        self.ragged: dict[str, list[np.ndarray]] = {}
        self.used: dict[str, int] = {}

    def rows(self, units: list[str]) -> np.ndarray:
        """Row number of every unit; rows beyond the bound hold until the next call."""
        code = np.fromiter(map(self.code.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(code < 0)
        if len(missing):
            new = [units[i] for i in missing]
            kept = len(self.code)
            code[missing] = kept + np.arange(len(new))
            keep = kept + len(new) <= self.bound
            for name, column in self.work(new).items():
                if isinstance(column, list):
                    held = self.lists.setdefault(name, [])
                    del held[kept:]
                    held += column
                else:
                    self._append(name, kept, *column, keep)
            if keep:
                self.code.update(zip(new, range(kept, kept + len(new))))
        return code

    def _append(self, name: str, kept: int, lengths: np.ndarray, flat: np.ndarray, keep: bool) -> None:
        if name not in self.ragged:
            self.ragged[name] = [np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, flat.dtype)]
            self.used[name] = 0
        used, arrays = self.used[name], self.ragged[name]
        for k, size in ((0, kept + len(lengths)), (1, kept + len(lengths)), (2, used + len(flat))):
            if size > len(arrays[k]):
                grown = np.zeros(max(size, len(arrays[k]) * 3 // 2), arrays[k].dtype)
                grown[: len(arrays[k])] = arrays[k]
                arrays[k] = grown
        arrays[0][kept: kept + len(lengths)] = lengths
        arrays[1][kept: kept + len(lengths)] = used + np.cumsum(lengths) - lengths
        arrays[2][used: used + len(flat)] = flat
        if keep:
            self.used[name] = used + len(flat)

    def lengths(self, name: str, rows: np.ndarray) -> np.ndarray:
        return self.ragged[name][0][rows] if len(rows) else np.zeros(0, np.int64)

    def gather(self, name: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, flat values) of a ragged column for ``rows`` in order."""
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        length, start, flat = self.ragged[name]
        n = length[rows]
        before = np.cumsum(n) - n
        return n, flat[np.repeat(start[rows] - before, n) + np.arange(int(n.sum()))]


@dataclass
class Cut:
    units: list[str]  # distinct
    codes: np.ndarray  # place in ``units`` of every unit of the cut texts, in order
    per_text: np.ndarray  # units of every text; 0 for the texts that are empty or whole
    whole: np.ndarray  # places of the texts that are not cut


def cut(texts: pa.Array, *, first_spaced: bool = False) -> Cut:
    """The units of every text of a string column (NULL: empty). With
    ``first_spaced`` a text's first word counts as having a space before it;
    a text that begins with a line break is then whole."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n_texts = len(texts)
    lines = pc.split_pattern(texts, "\n")
    line_words = pc.split_pattern(lines.flatten(), " ")
    coded = line_words.flatten().dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary
    lines_of = lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words_of = line_words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    line_text = np.repeat(np.arange(n_texts), lines_of)
    line_place = np.arange(len(words_of)) - np.repeat(np.cumsum(lines_of) - lines_of, lines_of)
    first_word = np.cumsum(words_of) - words_of
    none = word == pc.index(names, "").as_py()
    empty_line = (words_of == 1) & none[first_word] if len(words_of) else np.zeros(0, bool)
    # odd white space, or a space beside another or at a line's end, leaves the text whole
    bad = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False).astype(bool)
    at_none = np.searchsorted(first_word, np.flatnonzero(none), side="right") - 1
    bad |= np.bincount(line_text[at_none[~empty_line[at_none]]], minlength=n_texts) > 0
    full = np.flatnonzero(~empty_line & ~bad[line_text])
    text_of_full = line_text[full]
    visible_lines = np.bincount(text_of_full, minlength=n_texts)
    nothing = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    bad |= (visible_lines == 0) & ~nothing  # line breaks only
    new_text = np.ones(len(full), bool)
    new_text[1:] = text_of_full[1:] != text_of_full[:-1]
    previous = np.empty(len(full), np.int64)
    previous[1:] = line_place[full[:-1]]
    previous[new_text] = 0
    gap = line_place[full] - previous  # line breaks before the line
    if first_spaced:
        bad[text_of_full[new_text & (gap > 0)]] = True
        keep = ~bad[text_of_full]
        full, text_of_full, new_text, gap = full[keep], text_of_full[keep], new_text[keep], gap[keep]
    last = np.ones(len(full), bool)
    last[:-1] = new_text[1:]
    end_gap = np.where(last, lines_of[text_of_full] - 1 - line_place[full], 0)

    # words of the visible lines, then the runs of line breaks between them
    n_words = words_of[full]
    line_start = np.cumsum(n_words) - n_words
    every = len(full) == len(words_of)
    code = (word if every else word[np.repeat(first_word[full] - line_start, n_words) + np.arange(int(n_words.sum()))]) * 2 + 1
    bare = line_start if not first_spaced else line_start[~new_text]
    code[bare] -= 1
    used = np.zeros(2 * len(names), bool)
    used[code] = True
    distinct = np.flatnonzero(used)
    named = names.take(pa.array(distinct >> 1))
    units = pc.if_else(pa.array(distinct & 1 == 1), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), named, pa.scalar("", pa.large_string())), named).to_pylist()
    place = np.zeros(2 * len(names), np.int32)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    code = place[code]

    extra: dict[str, int] = {}

    def runs(sizes: np.ndarray, tail: str) -> np.ndarray:
        number = {k: extra.setdefault("\n" * (k - len(tail) // 2) + tail, len(units) + len(extra)) for k in np.unique(sizes).tolist()}
        return np.array([number[k] for k in sizes.tolist()], np.int64)

    has, has_end = np.flatnonzero(gap > 0), np.flatnonzero(end_gap > 0)
    at = np.concatenate([line_start[has], (line_start + n_words)[has_end]])
    put = np.concatenate([runs(gap[has], ""), runs(end_gap[has_end], TRAILING)])
    # at a text's border its trailing run comes before the next text's leading run
    tied = np.concatenate([np.ones(len(has), np.int64), np.zeros(len(has_end), np.int64)])
    order = np.lexsort((tied, at))
    if len(at):
        code = np.insert(code, at[order], put[order])
    per_text = np.bincount(text_of_full, weights=n_words + (gap > 0) + (end_gap > 0), minlength=n_texts).astype(np.int64)
    return Cut(units + list(extra), code, per_text, np.flatnonzero(bad))


def splice(lengths: np.ndarray, flat: np.ndarray, whole: np.ndarray, w_len: np.ndarray, w_flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put the values of the texts ``whole`` into their places among the others'."""
    if not len(whole):
        return lengths, flat
    at = np.repeat((np.cumsum(lengths) - lengths)[whole], w_len)
    lengths = lengths.copy()
    lengths[whole] = w_len
    return lengths, np.insert(flat, at, w_flat)


def text_lengths(lengths: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Values of every text from the values of every unit."""
    edges = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.cumsum(per_text)
    return edges[ends] - edges[ends - per_text]
