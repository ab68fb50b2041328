"""String and sequence functions, as native column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The standard genetic code, codons in the order TTT, TTC, TTA, TTG, TCT, ... GGG.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(("".join(c) for c in product("TCAG", repeat=3)), GENETIC_CODE, strict=True))


def codons_of(amino: str) -> list[str]:
    """Codons of an amino acid: larger boxes (equal first two bases) first, bases in the order T, C, A, G."""
    own = [c for c, a in CODONS.items() if a == amino]
    return sorted(own, key=lambda c: -sum(o[:2] == c[:2] for o in own))


FIRST_CODON = {a: codons_of(a)[0] for a in sorted(set(GENETIC_CODE))}


def literal_map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in d.items() for x in pair))


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def point_mutations(c: Column) -> Column:
    """All X<n>Y, each once, in text order, comma-joined; null where there is none."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Z][0-9]+[A-Z]"), 0)))
    return F.nullif(F.array_join(found, ","), F.lit(""))


def sequence_diff(wild: Column, mutant: Column, strict: bool = False) -> Column:
    """Substitutions between sequences of equal length, in text order; <X><n>del where the wild one is longer by one; else null.

    The place of a deletion is the first difference; with strict, what follows must agree too.
    """
    a, b = chars(wild), chars(mutant)
    places = F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p, i: F.when(p["x"] != p["y"], F.concat(p["x"], (i + 1).cast("string"), p["y"])))
    subs = F.nullif(F.array_join(F.array_sort(F.filter(places, lambda p: p.isNotNull())), ","), F.lit(""))
    same = F.transform(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda e, i: F.when(~e, i))
    first = F.get(F.filter(same, lambda i: i.isNotNull()), F.lit(0))
    gone = F.concat(F.get(a, first), (first + 1).cast("string"), F.lit("del"))
    if strict:
        gone = F.when(F.concat(F.substring(wild, F.lit(1), first), F.substring(wild, first + 2, F.length(wild))) == mutant, gone)
    return F.when(F.length(wild) == F.length(mutant), subs).when(F.length(wild) == F.length(mutant) + 1, gone)


def parse_mutation(c: Column) -> Column:
    """struct(ref, pos, alt) of a mutation at the start of the text; null where there is none."""
    part = lambda i: F.regexp_extract(c, "^([A-Z])([0-9]+)([A-Z])", i)
    return F.when(part(1) != "", F.struct(part(1).alias("ref"), part(2).try_cast("int").alias("pos"), part(3).alias("alt")))


def apply_edits(sequence: Column, edits: Column) -> Column:
    """A comma-joined set of mutations applied in turn; null if one is malformed, out of bounds, or not about the present letter."""

    def step(s: Column, m: Column) -> Column:
        p = parse_mutation(F.trim(m))
        ok = (p["pos"] >= 1) & (p["pos"] <= F.length(s)) & (F.substring(s, p["pos"], F.lit(1)) == p["ref"])
        return F.when(ok, F.overlay(s, p["alt"], p["pos"], F.lit(1)))

    return F.aggregate(F.split(edits, ","), sequence, step)


def translate_codons(cdna: Column, frame: int = 0) -> Column:
    """Amino acids of consecutive codons, ? for what is no codon."""
    starts = F.when(F.length(cdna) > frame, F.sequence(F.lit(1 + frame), F.length(cdna), F.lit(3))).otherwise(F.array().cast("array<int>"))
    table = literal_map(CODONS)
    return F.array_join(F.transform(starts, lambda i: F.coalesce(F.try_element_at(table, F.substring(cdna, i, F.lit(3))), F.lit("?"))), "")


def strip_unknown(c: Column) -> Column:
    return F.btrim(c, F.lit("?"))


def locate_context(query: Column, target: Column, pos: Column, offset: Column, window: int = 5) -> Column:
    """The place (from 0) in target of query's place pos: pos+offset if the surroundings agree, else where the query's surroundings occur; null if nowhere."""
    lo = F.greatest(F.lit(0), pos - window)
    context = F.substring(query, lo + 1, F.least(F.length(query), pos + window + 1) - lo)
    shifted = pos + offset
    tlo = F.greatest(F.lit(0), shifted - window)
    there = F.substring(target, tlo + 1, F.least(F.length(target), shifted + window + 1) - tlo)
    found = F.position(context, target)
    return F.when(context == there, shifted).when(found > 0, found - 1 + (pos - lo))


def codon_change(codon: Column, amino: Column) -> Column:
    """struct(at, ref, alt) that turns a codon into the first one of an amino acid: one base where that suffices, else the whole codon; null if nothing changes."""
    new = F.try_element_at(literal_map(FIRST_CODON), amino)
    at = F.filter(F.array(*(F.when(F.substring(codon, i, 1) != F.substring(new, i, 1), F.lit(i - 1)) for i in (1, 2, 3))), lambda x: x.isNotNull())
    i = F.get(at, F.lit(0))
    one = F.struct(i.alias("at"), F.substring(codon, i + 1, F.lit(1)).alias("ref"), F.substring(new, i + 1, F.lit(1)).alias("alt"))
    whole = F.struct(F.lit(0).alias("at"), codon.alias("ref"), new.alias("alt"))
    return F.when(F.size(at) == 1, one).when(F.size(at) > 1, whole)


def normalise_id(c: Column) -> Column:
    """The first four letters or digits in a row, in lower case; null where there are none."""
    return F.lower(F.nullif(F.regexp_extract(c, "[A-Za-z0-9]{4}", 0), F.lit("")))


def key_value(line: Column) -> Column:
    """struct(key, text, number) of a 'key: value' line; null without a colon."""
    from quartzloom.operators.clean import to_number

    parts, blank = F.split(line, ":", 2), F.lit(" \t\r\n\f\x0b")
    value = F.btrim(F.get(parts, F.lit(1)), blank)
    return F.when(F.size(parts) == 2, F.struct(F.btrim(parts[0], blank).alias("key"), value.alias("text"), to_number(value).alias("number")))


def spaced(c: Column) -> Column:
    return F.array_join(chars(c), " ")


def fasta_sequence(c: Column) -> Column:
    """The letters of a FASTA record, without its first line."""
    return F.regexp_replace(F.regexp_replace(c, "^[^\n]*\n?", ""), "\\s", "")


def run_name(target: Column, rate: Column, dims: Column, seed: Column) -> Column:
    return F.concat(target, F.lit("-lr"), rate.cast("string"), F.lit("-edim"), dims.cast("string"), F.lit("-seed"), seed.cast("string"))


def campaign_id(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 8)


def title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


#: Cells that a block of alignments holds in a row.
BLOCK = 200_000


def glocal_scores(a: list[str], b: list[str], match: float = 5, mismatch: float = -4, gap: float = -10, extend: float = -1) -> tuple[np.ndarray, np.ndarray]:
    """Best global alignments of a[k] with b[k], with free end gaps and affine inner gaps: scores, and starts of a in b (negative if b starts within a). A gap costs more to open than to extend.

    Pairs of like lengths go together, a row of all of them at a time.
    """
    if gap > extend:
        raise ValueError("opening a gap must not be cheaper than extending one")
    scores, starts = np.zeros(len(a)), np.zeros(len(a), int)
    sizes = np.array([(len(y), len(x)) for x, y in zip(a, b, strict=True)], int).reshape(-1, 2)
    order = np.lexsort((sizes[:, 1], sizes[:, 0]))
    order = order[(sizes[order] > 0).all(1)]
    while len(order):
        # as many pairs as fit, with room for the longest of them
        fit = np.arange(1, len(order) + 1) * (sizes[order, 0] + 1) <= BLOCK
        k = max(1, int(fit.argmin()) if not fit.all() else len(order))
        part, order = order[:k], order[k:]
        scores[part], starts[part] = _glocal([a[i] for i in part], [b[i] for i in part], match, mismatch, gap, extend)
    return scores, starts


def _letters(texts: list[str], size: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), size), fill, np.uint32)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _glocal(a: list[str], b: list[str], match: float, mismatch: float, gap: float, extend: float) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    x, y = _letters(a, n.max(), 2**32 - 1), _letters(b, m.max(), 2**32 - 2)  # no cell depends on the filling to its right or below
    count, low, pairs, places = len(a), -1e18, np.arange(len(a)), np.arange(m.max() + 1)
    h, up = np.zeros((count, len(places))), np.full((count, len(places)), low)  # row 0: leading letters of b are free
    h0 = np.broadcast_to(places, h.shape).copy()  # the diagonal start of each cell's path: place in b minus place in a
    up0 = h0.copy()
    best, start = np.full(count, low), np.zeros(count, int)
    zero, edge = np.zeros((count, 1)), np.full((count, 1), low)
    for i in range(1, n.max() + 1):
        score = np.where(x[:, i - 1 : i] == y, match, mismatch)
        opened = h + gap
        take = opened >= up + extend
        up, up0 = np.where(take, opened, up + extend), np.where(take, h0, up0)
        diag, diag0 = np.hstack([zero, h[:, :-1] + score]), np.hstack([np.full((count, 1), -i), h0[:, :-1]])
        top = np.where(diag >= up, diag, up)
        top0 = np.where(diag >= up, diag0, up0)
        top[:, 0], top0[:, 0] = 0.0, -i  # leading letters of a are free
        # a gap in a is best opened from a cell that is not in one, so the best opening before each place is a running maximum
        lead = top - places * extend
        last = np.maximum.accumulate(np.where(lead >= np.maximum.accumulate(lead, axis=1), places, 0), axis=1)[:, :-1]
        side = np.take_along_axis(top, last, 1) + gap + (places[1:] - last - 1) * extend
        better = side > top[:, 1:]
        h = np.hstack([top[:, :1], np.where(better, side, top[:, 1:])])
        h0 = np.hstack([top0[:, :1], np.where(better, np.take_along_axis(top0, last, 1), top0[:, 1:])])
        more = (i <= n) & (h[pairs, m] > best)  # trailing letters of a are free
        best[more], start[more] = h[pairs, m][more], h0[pairs, m][more]
        ends = np.flatnonzero(i == n)
        if len(ends):
            j = np.where(places <= m[ends, None], h[ends], low).argmax(1)
            more = h[ends, j] > best[ends]  # trailing letters of b are free
            best[ends[more]], start[ends[more]] = h[ends, j][more], h0[ends, j][more]
    return best, start


def glocal_score(a: str, b: str, match: float = 5, mismatch: float = -4, gap: float = -10, extend: float = -1) -> tuple[float, int]:
    """glocal_scores of one pair."""
    scores, starts = glocal_scores([a], [b], match, mismatch, gap, extend)
    return float(scores[0]), int(starts[0])


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("offset", T.IntegerType())]))
def align_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """glocal_score for pairs of texts; zero for missing ones. Equal pairs of a batch are aligned once."""
    for a, b in batches:
        pairs = pd.DataFrame({"a": a.to_numpy(object), "b": b.to_numpy(object)}).fillna("")
        first = ~pairs.duplicated()
        scores, starts = glocal_scores(pairs["a"][first].tolist(), pairs["b"][first].tolist())
        of = pairs.groupby(["a", "b"], sort=False).ngroup().to_numpy()
        yield pd.DataFrame({"score": scores[of], "offset": starts[of].astype("int32")})
