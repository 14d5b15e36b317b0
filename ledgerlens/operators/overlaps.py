"""How much sets have in common with all other sets, without a row for each pair.

Sets are numbered. What a set shares with those of a range of numbers is a count for each of them: a funder's holders are a mask
over the range, or their places where they are few, and a set's counts are the sum over its funders. Ranges and slices of the
sets make cells, which Spark deals out; a cell holds what its own sets hold and nothing for pairs, and each set leaves one row.
The work of sets that share common funders is quadratic by nature, some bytes of it a pair; sets whose funders are rare cost the
places that they name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Numbers in a range, least number of slices, most sets in a slice.
WIDTH, SLICES, SLICE = 1 << 17, 32, 1 << 16


def in_cells(asked: DataFrame, held: DataFrame, total: int, fold: str, width: int = WIDTH, upto: bool = False) -> DataFrame:
    """One row of ``fold`` for each set of ``asked`` and range of numbers in which it shares a funder with another.

    ``held(number, funder, n)`` has all sets, numbered from 0 to ``total``, and ``asked(number, funder, n, low)`` those to be
    compared. ``fold='count'`` gives ``number, shared``: how many others share a funder; with ``upto`` only those of numbers
    below ``low``. ``fold='best'`` gives ``number, i, u``: size of the common part and of the union where their ratio is
    greatest and at least ``low``; numbers must then rise with ``n``.
    """
    slices = max(SLICES, -(-total // SLICE))
    ranges = -(-total // width)
    last = F.least(F.lit(ranges - 1), F.floor(F.greatest(F.col("low") - 1, F.lit(0)) / width)).cast("int") if upto else F.lit(ranges - 1)
    left = asked.withColumns({"slice": F.pmod(F.xxhash64("number"), F.lit(slices)).cast("int"), "bucket": F.explode(F.sequence(F.lit(0), last))})
    # under names of its own, as both sides may stem from one table
    right = held.select(*[F.col(c).alias(c) for c in ("number", "funder", "n")]).withColumns({"bucket": F.floor(F.col("number") / width).cast("int"), "slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))})
    key = ["bucket", "slice"]
    schema = "number long, shared long" if fold == "count" else "number long, i long, u long"
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_cell(fold, width, upto), schema)


def _cell(fold: str, width: int, upto: bool):
    """The function of a cell. It refers to nothing of this module, so executors needn't have it."""

    def cell(key, left, right):
        import numpy as np
        import pandas as pd

        columns = ["number", "shared"] if fold == "count" else ["number", "i", "u"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
        base = int(key[0]) * width
        number, funder = right["number"].to_numpy(), right["funder"].to_numpy()
        order = np.argsort(funder, kind="stable")
        known, first = np.unique(funder[order], return_index=True)
        places = np.split((number - base)[order], first[1:])
        length = int(number.max()) - base + 1
        n = np.zeros(length, np.int64)
        n[number - base] = right["n"].to_numpy()
        # beginnings of the stretches of equal size, which follow each other
        starts = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))
        sizes, ends = n[starts], np.append(starts[1:], length)
        order = np.argsort(left["number"].to_numpy(), kind="stable")
        asked, theirs = left["number"].to_numpy()[order], left["funder"].to_numpy()[order]
        own, low = left["n"].to_numpy()[order], left["low"].to_numpy()[order]
        at = np.searchsorted(known, theirs)
        at = np.where(known[np.minimum(at, len(known) - 1)] == theirs, at, -1)
        masks: dict[int, np.ndarray] = {}

        def mask(f):
            if f not in masks:
                masks[f] = np.zeros(length, np.uint8)
                masks[f][places[f]] = 1
            return masks[f]

        out = []
        cuts = np.concatenate(([0], np.flatnonzero(asked[1:] != asked[:-1]) + 1, [len(asked)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            fs = [f for f in at[a:b].tolist() if f >= 0]
            if not fs:
                continue
            me, size, least = int(asked[a]), int(own[a]), float(low[a])
            lo, hi = 0, length
            if fold == "best":  # a set that reaches the ratio is neither too small nor too large
                s, e = np.searchsorted(sizes, least * size * (1 - 1e-9)), np.searchsorted(sizes, size / max(least, 1e-12) * (1 + 1e-9), side="right")
                if s >= e:
                    continue
                lo, hi = int(starts[s]), int(ends[e - 1])
            elif upto:
                hi = min(length, int(least) - base)
                if hi <= 0:
                    continue
            mine = me - base
            if sum(len(places[f]) for f in fs) * 16 < length:
                met, counts = np.unique(np.concatenate([places[f] for f in fs]), return_counts=True)
                keep = (met >= lo) & (met < hi) & (met != mine)
                met, counts = met[keep], counts[keep]
                if not len(met):
                    continue
                if fold == "count":
                    out.append((me, len(met)))
                    continue
                union = size + n[met] - counts
                k = int(np.argmax(counts / union))
                out.append((me, int(counts[k]), int(union[k])))
                continue
            counts = np.zeros(hi - lo, np.uint8 if len(fs) < 256 else np.uint32)
            for f in fs:
                if len(places[f]) * 64 >= length:
                    counts += mask(f)[lo:hi]
                else:
                    p = places[f]
                    counts[p[(p >= lo) & (p < hi)] - lo] += 1
            if lo <= mine < hi:
                counts[mine - lo] = 0
            if fold == "count":
                out.append((me, int(np.count_nonzero(counts))))
                continue
            most = np.maximum.reduceat(counts, starts[s:e] - lo).astype(np.int64)
            union = size + sizes[s:e] - most
            k = int(np.argmax(most / union))
            if most[k]:
                out.append((me, int(most[k]), int(union[k])))
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, len(columns)), columns=columns)

    return cell
