"""Alignment of pairs of sequences as DataFrame operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.functions import kernels

CELLS = 1 << 24  #: cells of one batch of pairs


def _batches(patterns: list[str], texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of pairs whose padded matrices stay within CELLS (or one pair)."""
    i = 0
    while i < len(patterns):
        j, p, t = i, 0, 0
        while j < len(patterns) and (j == i or (max(p, len(patterns[j])) + 1) * (max(t, len(texts[j])) + 1) * (j - i + 1) <= CELLS):
            p, t, j = max(p, len(patterns[j])), max(t, len(texts[j])), j + 1
        yield i, j
        i = j


def align(pairs: DataFrame, scheme: kernels.Scheme = kernels.EDIT, mode: str = "global", band: int | None = None, trace: bool = False, keep: tuple[str, ...] = ("pattern_id", "text_id")) -> DataFrame:
    """The kept columns with score, text_end, pattern_end and, with trace, text_begin, pattern_begin, nm (edits), cigar, md.

    pairs: pattern, text (a null pair has null results). Pairs are sorted by length within
    their batch, so that padding is small.
    """
    fields = {f.name: f.dataType.simpleString() for f in pairs.schema}
    ints = ["score", "text_end", "pattern_end", *(["text_begin", "pattern_begin", "nm"] if trace else [])]
    names = [*ints, *(["cigar", "md"] if trace else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, t = b.column("pattern").to_pylist(), b.column("text").to_pylist()
            order = sorted((k for k in range(len(p)) if p[k] is not None and t[k] is not None), key=lambda k: (len(p[k]), len(t[k])))
            got: list[dict] = [{} for _ in p]
            ps, ts = [p[k] for k in order], [t[k] for k in order]
            for i, j in _batches(ps, ts):
                for k, r in zip(order[i:j], kernels.align(ps[i:j], ts[i:j], scheme, mode, band, trace), strict=True):
                    got[k] = r
                    if trace and r["score"] is not None:
                        r["md"] = md_string(p[k], t[k], r)
                        r["nm"] = edits(r["cigar"], r["md"])
            cols = [pa.array([r.get(c) for r in got], pa.int32() if c in ints else pa.string()) for c in names]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *names])

    schema = [f"`{c}` {fields[c]}" for c in keep] + [f"{c} {'int' if c in ints else 'string'}" for c in names]
    return pairs.select(*dict.fromkeys([*keep, "pattern", "text"])).mapInArrow(run, ", ".join(schema))


def global_distance(pattern: Column, text: Column) -> Column:
    """The global edit-distance score: built in, so it needs no Python."""
    return -F.levenshtein(pattern, text)


_OPS = "([0-9]+)([MIDNS])"


def cigar_ops(cigar: Column) -> Column:
    """A CIGAR string as an array of structs (n, op)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(_OPS), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, _OPS, 1).cast("int").alias("n"), F.regexp_extract(x, _OPS, 2).alias("op")))


def _total(cigar: Column, *ops: str) -> Column:
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["op"].isin(*ops)), F.lit(0), lambda a, x: a + x["n"])


def reference_length(cigar: Column) -> Column:
    return _total(cigar, "M", "D", "N")


def read_length(cigar: Column) -> Column:
    return _total(cigar, "M", "I", "S")


def gap_counts(cigar: Column) -> tuple[Column, Column]:
    """Gap openings and gap extensions."""
    gaps = F.filter(cigar_ops(cigar), lambda x: x["op"].isin("I", "D"))
    return F.size(gaps), F.aggregate(gaps, F.lit(0), lambda a, x: a + x["n"] - 1)


def edits(cigar: str, md: str) -> int:
    """The number of mismatching, inserted and deleted symbols."""
    inserted = sum(int(n) for n in re.findall(r"(\d+)I", cigar))
    return inserted + sum(c.isalpha() for c in md)


def md_string(pattern: str, text: str, result: dict) -> str:
    """The MD tag of a traced alignment: runs of matches, mismatching text symbols, ^ and deleted ones."""
    i, j, run, out = result["text_begin"], result["pattern_begin"], 0, []
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MID])", result["cigar"])):
        if op == "M":
            for k in range(n):
                if text[i + k] == pattern[j + k]:
                    run += 1
                else:
                    out.append(f"{run}{text[i + k]}")
                    run = 0
        elif op == "D":
            out.append(f"{run}^{text[i : i + n]}")
            run = 0
        i, j = i + (n if op != "I" else 0), j + (n if op != "D" else 0)
    return "".join(out) + str(run)
