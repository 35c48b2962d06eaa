"""Fill-in-the-middle transformation of whole texts by run-length classes of characters.

A text is stored as its maximal runs of one character class, each with its first byte, the units
before it and the bytes of one unit.  A cut after k units is found by binary search for the run that
holds it and arithmetic inside that run, so no text is turned into a list of characters.  Units are

* ``char``: code points; classes are the widths of their UTF-8 forms, a unit is one character;
* ``word``: a maximal run of word characters (ASCII letters, digits, ``_`` and all bytes outside
  ASCII) or of ASCII white space is one unit, every other character is one.

Two draws place the cuts: prefix, middle and suffix are the units before, between and after them.
A third draw leaves some texts plain, a fourth chooses suffix-prefix-middle order over
prefix-suffix-middle.  Draws are the first four 8-digit groups of the SHA-256 of ``seed:id``, so a
row's result depends on nothing but its id and text.  Texts that hold a marker stay plain, so the
markers of an output part it without doubt, and ``restored`` rebuilds every text exactly.

Defined results: null text counts as empty; empty texts are plain; a null id draws as the empty
string; repeated rows are cut alike; an empty table gives no rows; other columns are not read.  Work
and memory are linear in a text of any length; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, text_batches
from .segments import groups, texts

MARKERS = ("<P>", "<S>", "<M>")
SHAPE = "doc_id {id}, text string, n long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string"
_TAIL = 0  # class of continuation bytes


def _classes(unit: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its class, and for each class the bytes of a unit (0: the whole run is one)."""
    kinds = np.zeros(256, np.uint8)
    if unit == "char":
        kinds[:0x80], kinds[0xC0:0xE0], kinds[0xE0:0xF0], kinds[0xF0:] = 1, 2, 3, 4
        return kinds, np.array([0, 1, 2, 3, 4])
    if unit == "word":
        kinds[:0x80] = 1
        kinds[[b for b in range(256) if b >= 0x80 or chr(b).isalnum() or b == ord("_")]] = 2
        kinds[list(b" \t\n\v\f\r")] = 3
        return kinds, np.array([0, 1, 0, 0])
    raise ValueError(f"unit must be 'char' or 'word', not {unit!r}")


class Runs:
    """Maximal class runs of texts that lie one after the other in ``data``, with cumulative units."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "char") -> None:
        kinds, width = _classes(unit)
        kind = kinds[data]
        fresh = np.ones(len(data), bool)
        np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
        first = offsets[:-1][np.diff(offsets) > 0]
        fresh[first] = True
        at = np.nonzero(fresh & (kind != _TAIL))[0]
        # Characters of one width that follow each other differ from their own continuation bytes only.
        same = np.zeros(len(at), bool)
        same[1:] = kind[at[1:]] == kind[at[:-1]]
        same[np.searchsorted(at, first)] = False
        self.start = at[~same]
        size = np.diff(np.append(self.start, len(data)))
        own = width[kind[self.start]]
        self.width = np.where(own > 0, own, size)
        self.before = np.append(0, np.cumsum(size // np.maximum(self.width, 1)))  # one longer than the runs
        self.base = self.before[np.searchsorted(self.start, offsets)]  # units before each text

    def units(self) -> np.ndarray:
        return np.diff(self.base)

    def place(self, text: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The byte at which ``units`` units of each ``text`` end."""
        if not len(self.start):
            return np.zeros(len(text), np.int64)
        want = self.base[text] + units
        run = np.clip(np.searchsorted(self.before, want, side="right") - 1, 0, len(self.start) - 1)
        return self.start[run] + (want - self.before[run]) * self.width[run]


def _checked(markers: tuple[str, str, str]) -> None:
    """Markers must part any texts that hold none of them: no end of one is the start of one."""
    for i, a in enumerate(markers):
        for j, b in enumerate(markers):
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers {a!r} and {b!r} may overlap in an output")


def transform(
    docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, unit: str = "char", markers: tuple[str, str, str] = MARKERS, seed: int = 1,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), see ``SHAPE``; ``form`` is plain, psm or spm.

    ``n``, ``prefix_units`` and ``middle_units`` count units, the ``_chars`` columns code points;
    all four cuts are null in plain rows.  ``output`` is the text for training, ``text`` the one it came from.
    """
    _checked(markers)
    _classes(unit)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *draws)
    shape = SHAPE.format(id=docs.schema["doc_id"].dataType.simpleString())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            held = np.zeros(len(batch), bool)
            for marker in markers:
                held |= pc.match_substring(batch.column(1), marker).to_numpy(zero_copy_only=False)
            h = [batch.column(k).to_numpy() for k in range(2, 6)]
            for lo, hi in groups(offsets):
                yield _part(batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], held[lo:hi], [x[lo:hi] for x in h])

    def _part(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, held: np.ndarray, h: list[np.ndarray]) -> pa.RecordBatch:
        runs = Runs(data, offsets, unit)
        n, every = runs.units(), np.arange(len(batch))
        low, high = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
        plain = (n == 0) | held | (h[2] % 100 >= 100 - plain_percent)
        spm = h[3] % 100 < spm_percent
        ends = np.stack([runs.place(every, low), runs.place(every, high)])
        lengths = (low, high - low) if unit == "char" else (_chars(data, offsets[:-1], ends[0]), _chars(data, ends[0], ends[1]))
        raw, out = data.tobytes(), []
        p, s, m = (x.encode() for x in markers)
        for k, (a, b, c, d) in enumerate(zip(offsets[:-1].tolist(), ends[0].tolist(), ends[1].tolist(), offsets[1:].tolist(), strict=True)):
            if plain[k]:
                out.append(raw[a:d])
            elif spm[k]:
                out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
            else:
                out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        shown = lambda x: pa.array(x.astype(np.int64), pa.int64(), mask=plain)
        columns = [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()), shown(low), shown(high - low), shown(lengths[0]), shown(lengths[1]), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in shape.split(", ")])

    return text_batches(rows).mapInArrow(lean(cut), shape)


def _chars(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points of ``data`` between each start and end."""
    upto = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return upto[end] - upto[start]


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text of an output, from nothing but it and its form."""
    _checked(markers)
    p, s, m = markers
    quoted = [r"\Q" + x.replace(r"\E", r"\E\\E\Q") + r"\E" for x in markers]
    parts = lambda first, second: F.split(F.substr(output, F.lit(len(first) + 1)), f"{second}|{quoted[2]}")
    whole = lambda c, order: F.transform(F.array(c), lambda x: F.concat(*(x[k] for k in order)))[0]
    return F.when(form == "psm", whole(parts(p, quoted[1]), (0, 2, 1))).when(form == "spm", whole(parts(s, quoted[0]), (1, 2, 0))).otherwise(output)
