"""Similarity of values, and arrays merged by it. Plain Python: the order in which elements are matched is
the result. Upper bounds that need no matcher are given as columns as well."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docfold.config import MergeConfig
from docfold.operators.matching import Against, Scalars, Texts, first_of_best, is_scalar, length_bound as text_bound


def text_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp, with the matcher's popularity heuristic, existing text first. Equal texts are 1."""
    return Against(b).ratio(a)


def upper(a: Any, b: Any, weights: dict[str, float], path: str = "") -> float:
    """No similarity is above it: texts count by their lengths, lists by theirs."""
    if type(a) is not type(b):
        return 0.0
    if isinstance(a, str):
        return text_bound(a, b)
    if isinstance(a, list):
        return min(len(a), len(b)) / max(len(a), len(b)) if a or b else 1.0
    return _of_mappings(a, b, weights, path, upper) if isinstance(a, dict) else float(a == b)


def _of_mappings(a: dict, b: dict, weights: dict[str, float], path: str, of: Any) -> float:
    """What ``of`` says of the values of shared keys, weighted, over the keys of both."""
    total = got = 0.0
    for k in sorted(a.keys() | b.keys(), key=str):
        at = f"{path}.{k}" if path else str(k)
        w = float(weights.get(at, weights.get(str(k), 1.0)))
        total += w
        if k in a and k in b:
            got += w * of(a[k], b[k], weights, at)
    return got / total if total > 0 else 1.0


def similarity(a: Any, b: Any, weights: dict[str, float], path: str = "", least: float = 0.0) -> float:
    """0 to 1. Values of different types are 0. Texts whose bound is under ``least`` may come out as 0."""
    if type(a) is not type(b):
        return 0.0
    if isinstance(a, str):
        return 0.0 if text_bound(a, b) < least else text_ratio(a, b)
    if isinstance(a, dict):
        return _of_mappings(a, b, weights, path, similarity)
    if isinstance(a, list):
        if not a and not b:
            return 1.0
        if not a or not b:
            return 0.0
        free, scores = list(range(len(b))), []
        for x in a:
            best, at = -1.0, None
            for j in free:
                if (s := similarity(x, b[j], weights, path)) > best:
                    best, at = s, j
            if at is not None:
                free.remove(at)
                scores.append(max(best, 0.0))
            else:
                scores.append(0.0)
        return sum(scores) / len(a) * min(len(a), len(b)) / max(len(a), len(b))
    return 1.0 if a == b else 0.0


def merged_array(current: list, incoming: list, config: MergeConfig) -> list:
    """Each incoming element takes the place of the most similar existing one that no other has taken, if they
    are similar enough and at all; else it is appended, where later ones may still take its place."""
    if config.array_policy == "replace":
        return list(incoming)
    out, least, weights = list(current), config.similarity_threshold, config.field_weights
    texts, scalars = Texts(out), Scalars(out)
    rest = [i for i, y in enumerate(out) if not isinstance(y, str) and not is_scalar(y)]
    bounded = all(w >= 0 for w in weights.values())
    for x in incoming:
        if isinstance(x, str):
            best, at = texts.best(x, least)
        elif is_scalar(x):
            best, at = scalars.best(x)
        else:
            bound = lambda i: upper(out[i], x, weights) if bounded else float("inf")  # noqa: B023, E731
            best, at = first_of_best(rest, bound, lambda i: similarity(out[i], x, weights), least)  # noqa: B023
        if at is not None and best >= least:
            # Taken: nothing else takes its place.
            if isinstance(x, str):
                texts.remove(at)
            elif is_scalar(x):
                scalars.remove(at, x)
            else:
                rest.remove(at)
            out[at] = x
            continue
        out.append(x)
        if isinstance(x, str):
            texts.add(len(out) - 1, x)
        elif is_scalar(x):
            scalars.add(len(out) - 1, x)
        else:
            rest.append(len(out) - 1)
    return out


def merged(current: Any, incoming: Any, config: MergeConfig) -> Any:
    """Mappings key by key, arrays by similarity; all else is replaced."""
    if isinstance(current, dict) and isinstance(incoming, dict):
        out = dict(current)
        for k, v in incoming.items():
            out[k] = merged(out[k], v, config) if k in out else v
        return out
    if isinstance(current, list) and isinstance(incoming, list):
        return merged_array(current, incoming, config)
    return incoming


def seq_ratio(a: Column | str, b: Column | str) -> Column:
    """Similarity of two text columns, ``b`` being the incoming one; null where one is. A batch's distinct pairs are
    matched once, those of one incoming text with one table of it."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        both = a.notna() & b.notna()
        pairs: dict[str, dict[str, float]] = {}
        for x, y in zip(a[both], b[both], strict=True):
            pairs.setdefault(y, {})[x] = 0.0
        for y, own in pairs.items():
            against = Against(y)
            for x in own:
                own[x] = against.ratio(x)
        return pd.Series([pairs[y][x] if ok else None for x, y, ok in zip(a, b, both, strict=True)], dtype="float64")

    return F.pandas_udf(run, DoubleType())(a, b)


def best_matches(existing: DataFrame, incoming: DataFrame, keys: list[str], least: float, part: int = 4096) -> DataFrame:
    """(keys, no, place, ratio): for each text of ``incoming`` (keys, no, text) the most similar one of ``existing`` (keys, place, text) with the
    same keys, the least place of several; none below ``least``. Null texts are like none, null keys match nothing.

    A task indexes the existing texts of a key (see ``matching.Texts``) and looks each incoming one up. Keys of more than ``part`` texts on a
    side are cut into blocks of a part of the ones and a part of the others, so no task holds more than that."""
    parts = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / part).cast("int").alias(name))
    existing, incoming = existing.where("text IS NOT NULL"), incoming.where("text IS NOT NULL")
    sizes = parts(existing, "es").join(parts(incoming, "is"), keys)
    own = lambda no, of: F.pmod(F.xxhash64(no), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    hosts = existing.join(sizes, keys).select(*keys, F.col("place").cast("long").alias("no"), "text", F.lit(False).alias("asks"), own("place", "es").alias("e"), every("is").alias("i"))
    guests = incoming.join(sizes, keys).select(*keys, F.col("no").cast("long").alias("no"), "text", F.lit(True).alias("asks"), own("no", "is").alias("i"), every("es").alias("e"))
    block = [*keys, "e", "i"]

    def run(batches):
        key, texts, places, index = None, [], [], None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                at = tuple(getattr(r, c) for c in block)
                if at != key:
                    key, texts, places, index = at, [], [], None
                if not r.asks:
                    texts.append(r.text)
                    places.append(r.no)
                    continue
                index = index or Texts(texts)
                ratio, where = index.best(r.text, least)
                if where is not None and ratio >= least:
                    out.append((*at[:-2], r.no, places[where], ratio))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "no", "place", "ratio"])

    kinds = ", ".join(f"`{k}` {existing.schema[k].dataType.simpleString()}" for k in keys)
    rows = hosts.unionByName(guests).repartition(*block).sortWithinPartitions(*block, "asks", "no").select(*block, "asks", "no", "text")
    found = rows.mapInPandas(run, f"{kinds}, no long, place long, ratio double")
    return found.groupBy(*keys, "no").agg(F.max(F.struct("ratio", (-F.col("place")).alias("p"))).alias("x")).select(*keys, "no", (-F.col("x.p")).alias("place"), "x.ratio")


def length_bound(a: Column, b: Column) -> Column:
    """An upper bound of seq_ratio from lengths; 1 for two empty texts."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * F.least(la, lb) / (la + lb))


def bag_bound(a: Column, b: Column) -> Column:
    """An upper bound of seq_ratio from the characters that both have, as often as both have them."""
    ca, cb = F.split(a, ""), F.split(b, "")
    count = lambda xs, c: F.size(F.filter(xs, lambda x: x == c))
    shared = F.aggregate(F.array_distinct(F.filter(ca, lambda c: c != "")), F.lit(0), lambda n, c: n + F.least(count(ca, c), count(cb, c)))
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * shared / (la + lb))


def flat_similarity(a: Column, b: Column, weights: dict[str, float]) -> Column:
    """Weighted share of equal values of two maps of one primitive type, over the keys of both."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
    w = lambda k: F.coalesce(F.try_element_at(known, k), F.lit(1.0))
    total = F.aggregate(keys, F.lit(0.0), lambda s, k: s + w(k))
    got = F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.when(F.try_element_at(a, k) == F.try_element_at(b, k), w(k)).otherwise(0.0))
    return F.when(total <= 0, F.lit(1.0)).otherwise(got / total)
