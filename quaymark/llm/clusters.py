"""Grouping of requests into clusters of mutually similar ones (problem 1).

Texts name what they are about by anchors - a component, a place in its code,
an error code - and describe it in words.  Records are put into blocks by
their component; a record without one follows the records of the same place
and code.  Records without any anchor are one block together, whatever their
number.  Within a block a Gaussian mixture is fitted by expectation
maximisation on standardised, reduced features, with a covariance that is
pulled towards a prior, and fields that a text does not have are left out of
its likelihood.  The covariance of the words is tied between all components:
that of the wording inside known jobs, which the reduction makes a unit, or
what the directions that are not kept have.  Components are split in two as
long as the Bayesian information criterion says so; the members of the highest
density represent a cluster.  All blocks of a task are fitted in one batch of
array operations; a block that no task can hold is split by passes over all.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.operators.joins import small
from quaymark.session import cut_table

WORD_DIMS = 96  # hashed word features before the reduction
SCALE = 16.0  # steps that a word feature is kept in
KEPT_DIMS = 20  # after the reduction
ANCHOR_DIMS = 12  # of the place and of the code
MAX_PARTS = 4096  # size of a learned word list: its most used words

_BLOCK = re.compile(r"```.*?```", re.DOTALL)
_ITEM = re.compile(r"[^\W_]+(?:[-_.+@][^\W_]+)*")
_CODE = re.compile(r"([A-Za-z]{1,4})[-_]?(\d{3,6})")
_CAMEL = re.compile(r"[A-Z][a-z]+|^[a-z]+")
_FILES = frozenset("py rs go ts tsx js java kt sql cpp cc c h rb php scala cs sh".split())


def _pieces(item: str) -> tuple[str, ...]:
    """Parts of a compound identifier in lower case, without a file's ending; () if it is none."""
    if "." in item:
        head, _, tail = item.rpartition(".")
        if tail.lower() in _FILES:
            item = head
    if "_" in item or "." in item or "-" in item:
        parts = tuple(item.lower().replace(".", "_").replace("-", "_").split("_"))
        return parts if all(p.isalpha() for p in parts) else ()
    if not item.isalpha() or item.islower() or item.isupper():
        return ()
    parts = tuple(_CAMEL.findall(item))
    return tuple(p.lower() for p in parts) if len(parts) > 1 and sum(map(len, parts)) == len(item) else ()


def split_anchors(text: str) -> list[tuple[str, tuple[str, ...]]]:
    """Identifiers of a text that are joined by a sign: ('pair', (stem, kind)) and ('place', parts)."""
    out: list[tuple[str, tuple[str, ...]]] = []
    for item in _JOINED.findall(text):
        parts = _pieces(item)
        if len(parts) == 2 and len(parts[0]) >= 4 and len(parts[1]) >= 4 and "." not in item:
            out.append(("pair", parts))
        elif len(parts) == 3 and "-" not in item and ("_" in item or item.count(".") < 2):
            out.append(("place", parts))
    return out


_JOINED = re.compile(r"(?<![\w@/.-])[A-Za-z]{2,}(?:[-_.][A-Za-z]+)+(?![\w@-])")


SHARES = {"kind": 0.1, "part": 0.01}  # of the most usual word of a list, for a word to be on it


def learn_lists(texts: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """(kinds, parts) of the corpus, from every text.

    A kind is the second half of compounds with many different first halves,
    at least a tenth as many as the most usual kind has.  A part is a word that
    places are made of, with at least a hundredth of the most usual part's uses.
    The shares hold for a corpus of any size; a list has at most its MAX_PARTS
    most used words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str, str], int] = {}
        for pdf in batches:
            for t in pdf["text"]:
                for what, parts in split_anchors(t) if t else ():
                    if what == "pair":
                        seen[("kind", parts[1], parts[0])] = 1
                    else:
                        for p in parts:
                            seen[("part", p, "")] = seen.get(("part", p, ""), 0) + 1
            if len(seen) > 200_000:
                yield frame(seen)
                seen = {}
        yield frame(seen)

    def frame(seen: dict[tuple[str, str, str], int]) -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["what", "word", "left", "n"])

    found = texts.where("text is not null").select("text").mapInPandas(run, "what string, word string, left string, n long")
    counts = found.groupBy("what", "word").agg(F.when(F.col("what") == "kind", F.approx_count_distinct("left")).otherwise(F.sum("n")).alias("n"))
    counts = cut_table(counts)  # one row for each word of an identifier
    least = {r["what"]: r["n"] * SHARES[r["what"]] for r in counts.groupBy("what").agg(F.max("n").alias("n")).collect()}
    lists = {what: frozenset(r["word"] for r in counts.where((F.col("what") == what) & (F.col("n") >= least.get(what, 0))).orderBy(F.desc("n"), "word").limit(MAX_PARTS).collect()) for what in SHARES}
    return lists["kind"], lists["part"]


@lru_cache(maxsize=200_000)
def _near(word: str, vocabulary: frozenset[str]) -> str | None:
    """The word itself, or the one word of the vocabulary that is one slip away from it."""
    if word in vocabulary:
        return word
    forms = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    forms |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abcdefghijklmnopqrstuvwxyz"}
    hits = {f for f in forms if f in vocabulary}
    return hits.pop() if len(hits) == 1 else None


@dataclass(frozen=True)
class Lists:
    kinds: frozenset[str]
    parts: frozenset[str]

    def place(self, parts: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(sorted(_near(p, self.parts) or p for p in parts))

    def segment(self, word: str) -> tuple[str, ...] | None:
        """Three known parts that a run of letters is made of."""
        for i in range(2, len(word) - 3):
            if word[:i] in self.parts:
                for j in range(i + 2, len(word) - 1):
                    if word[i:j] in self.parts and word[j:] in self.parts:
                        return tuple(sorted((word[:i], word[i:j], word[j:])))
        return None


@lru_cache(maxsize=100_000)
def _signs(word: str, dims: int) -> np.ndarray:
    bits = np.frombuffer(xxhash.xxh128(word.encode()).digest(), np.uint8)  # 128 of them
    return (np.unpackbits(bits)[:dims].astype(np.int8) * 2 - 1).astype(np.float32)


def parse(text: str, lists: Lists) -> tuple[str | None, str | None, str | None, list[str]]:
    """(component, place, code, other words); an anchor that is not there is None."""
    if "```" in text:
        text = _BLOCK.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    comp = place = code = None
    words: list[str] = []
    for item in _ITEM.findall(text):
        if item.isalpha() and (item.islower() or item[1:].islower() or item.isupper()):
            words.append(item.lower())
            continue
        if code is None and (m := _CODE.fullmatch(item)):
            code = m.group(1).lower() + m.group(2)
            continue
        parts = _pieces(item)
        if comp is None and len(parts) == 2 and len(parts[0]) >= 4 and (kind := _near(parts[1], lists.kinds)):
            comp = f"{parts[0]}-{kind}"
        elif place is None and len(parts) == 3 and "-" not in item and ("_" in item or item.count(".") < 2):
            place = "_".join(lists.place(parts))
        elif not (m := _CODE.fullmatch(item)):
            words += [w for w in (parts or (item.lower(),)) if w.isalpha()]
    if comp is None:
        for i in range(len(words) - 1):
            a = words[i]
            kind = _near(words[i + 1], lists.kinds) if len(a) >= 6 and a not in lists.parts else None
            # a slip at the end may as well be another form of the word, or another word
            if kind and (kind == words[i + 1] or not (kind.startswith(words[i + 1]) or words[i + 1].startswith(kind))):
                comp = f"{a}-{kind}"
                words = words[:i] + words[i + 2 :]
                break
    if comp is None or place is None:
        rest: list[str] = []
        for w in words:
            if len(w) >= 10:
                kind = next((k for k in lists.kinds if w.endswith(k) and len(w) >= len(k) + 5), None) if comp is None else None
                if kind:
                    comp = f"{w[: -len(kind)]}-{kind}"
                    continue
                if place is None and (parts := lists.segment(w)):
                    place = "_".join(parts)
                    continue
            rest.append(w)
        words = rest
    return comp, place, code, [w for w in words if len(w) > 1]


class WordFeatures:
    """Sums of hashed signs of a text's different words over the root of their number, for whole batches."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.signs = np.empty((4096, WORD_DIMS), np.int8)

    def _id(self, word: str) -> int:
        i = self.ids[word] = len(self.ids)
        if i == len(self.signs):
            self.signs = np.concatenate([self.signs, np.empty_like(self.signs)])
        self.signs[i] = _signs(word, WORD_DIMS)
        return i

    def of(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.ids) > 50_000:  # most words are names that are seen once; the usual ones come back at once
            self.ids.clear()
        ids, flat, sizes = self.ids, [], []
        for words in texts:
            different = set(words)
            sizes.append(len(different))
            flat += [ids[w] if w in ids else self._id(w) for w in different]
        size = np.array(sizes, np.int64)
        out = np.zeros((len(texts), WORD_DIMS), np.float32)
        if flat:
            full = np.flatnonzero(size)
            out[full] = np.add.reduceat(self.signs[flat], (np.cumsum(size) - size)[full], axis=0, dtype=np.int16)
        return out / np.sqrt(np.maximum(size, 1))[:, None].astype(np.float32)


# -- the mixture ------------------------------------------------------------

DIMS = KEPT_DIMS + 2 * ANCHOR_DIMS
PRIOR_VARIANCE = np.r_[np.full(KEPT_DIMS, 1.5), np.full(2 * ANCHOR_DIMS, 0.05)].astype(np.float32)
WORD_SPREAD = 1.5  # how much wider than the wording of known jobs the covariance of the words is taken, since a job is worded in a few ways
PRIOR_WEIGHT = 10.0  # observations that the prior variance counts as
EM_ROUNDS = 12
_LOG_2PI = float(np.log(2 * np.pi))


@dataclass(frozen=True)
class Reduction:
    """Standardisation of the word features and their projection to the directions of most variance."""

    mean: np.ndarray
    project: np.ndarray
    noise: float = 1.0  # variance of the wording of one job in a direction
    spread: float = 1.0  # the same where anchors tell jobs apart
    kept: int = KEPT_DIMS  # directions that count; the rest are not observed

    @classmethod
    def of(cls, n: float, total: np.ndarray, products: np.ndarray, within: np.ndarray | None = None) -> Reduction:
        """``within``: covariance inside groups known to be alike.  Features are scaled to it, and those
        directions are kept that vary most between groups.  Without it the directions of more than average
        variance are kept, and what the others have is the noise, as in a probabilistic component analysis."""
        if n < 2:
            return cls(np.zeros(WORD_DIMS, np.float32), np.eye(WORD_DIMS, KEPT_DIMS, dtype=np.float32))
        mean = total / n
        cov = products / n - np.outer(mean, mean)
        known = within is not None
        if not known:
            within = np.diag(np.diag(cov))
        noise = within + np.eye(WORD_DIMS) * max(1e-6, 0.05 * np.trace(within) / WORD_DIMS)
        values, vectors = np.linalg.eigh(noise)
        whiten = vectors / np.sqrt(values)
        values, vectors = np.linalg.eigh(whiten.T @ cov @ whiten)
        top = np.argsort(-values, kind="stable")[:KEPT_DIMS]
        project = whiten @ vectors[:, top]
        project = project * np.sign(project[np.abs(project).argmax(0), np.arange(len(top))])
        return cls(mean.astype(np.float32), project.astype(np.float32), *((1.0, 1.0, KEPT_DIMS) if known else cls._noise(values)))

    def of_block(self, block: str) -> float:
        """The variance of the wording in a block.

        Where no job is known, records without anchors can only be told apart by
        the directions of more than average variance, the rest being noise; records
        with anchors are told apart by those, so all that words vary is wording.
        """
        return self.noise if block.startswith(UNANCHORED) else self.spread

    @staticmethod
    def _noise(values: np.ndarray) -> tuple[float, float, int]:
        values = np.sort(values[values > 1e-6])[::-1]
        kept = min(KEPT_DIMS, max(1, int((values > values.mean()).sum()))) if len(values) else KEPT_DIMS
        if not len(values):
            return 1.0, 1.0, kept
        return float(values[kept:].mean() if len(values) > kept else max(0.5 * values.mean(), 1e-3)), float(values[:kept].mean()), kept


def features(place: list[str | None], code: list[str | None], words: np.ndarray, reduction: Reduction) -> tuple[np.ndarray, np.ndarray]:
    """(values, observed) of DIMS columns; the fields that a record lacks are not observed."""
    n = len(place)
    x = np.zeros((n, DIMS), np.float32)
    seen = np.zeros((n, DIMS), bool)
    x[:, :KEPT_DIMS] = (words - reduction.mean) @ reduction.project
    seen[:, : reduction.kept] = True
    a, b = KEPT_DIMS, KEPT_DIMS + ANCHOR_DIMS
    for i, (p, c) in enumerate(zip(place, code)):
        if p is not None:
            parts = p.split("_")
            x[i, a:b] = sum(_signs(q, ANCHOR_DIMS) for q in parts) / np.float32(np.sqrt(len(parts)))
            seen[i, a:b] = True
        if c is not None:
            x[i, b:] = _signs(c, ANCHOR_DIMS)
            seen[i, b:] = True
    return x, seen


def _maximise(x: np.ndarray, m: np.ndarray, r: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, regularised variances and shares of components from responsibilities r (B, n, K)."""
    return _from_sums(np.einsum("bnk,bnd->bkd", r, m), np.einsum("bnk,bnd->bkd", r, m * x), np.einsum("bnk,bnd->bkd", r, m * x * x), r.sum(1), noise)


def _from_sums(rm: np.ndarray, total: np.ndarray, square: np.ndarray, size: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_maximise from its sufficient statistics: weights, sums and squares (B, K, d) and sizes (B, K).

    The covariance of the words is tied between all components, since words alone are thin evidence; ``noise``: (B,).
    """
    mean = total / np.maximum(rm, 1e-6)
    spread = np.maximum(square - rm * mean * mean, 0)
    var = (spread + PRIOR_WEIGHT * PRIOR_VARIANCE) / (rm + PRIOR_WEIGHT)
    var[:, :, :KEPT_DIMS] = WORD_SPREAD * np.maximum(noise, 1e-6)[:, None, None]
    share = size / np.maximum(size.sum(1), 1e-6)[:, None]
    # a component without any observation of a field says nothing about it
    return np.where(rm > 1e-3, mean, np.nan), var, share


def _penalty(parameters: np.ndarray | int, n: np.ndarray | float) -> np.ndarray:
    """Of the information criterion; n counts from 2 on, since one of two points is no evidence of its own."""
    return parameters * np.log(n + 2.0)


def _log_density(x: np.ndarray, m: np.ndarray, mean: np.ndarray, var: np.ndarray, fallback: np.ndarray, fallback_var: np.ndarray) -> np.ndarray:
    """(B, n, K) log density over the observed fields; a field that a component has never seen has the density of all."""
    unseen = np.isnan(mean)
    mu = np.where(unseen, fallback, mean)
    v = np.where(unseen, fallback_var, var)
    inv = 1 / v
    quad = np.einsum("bnd,bkd->bnk", m * x * x, inv) - 2 * np.einsum("bnd,bkd->bnk", m * x, mu * inv) + np.einsum("bnd,bkd->bnk", m, mu * mu * inv)
    logs = np.einsum("bnd,bkd->bnk", m, np.log(v) + _LOG_2PI)
    return -0.5 * (quad + logs)


def _try_split(x: np.ndarray, m: np.ndarray, w: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node of the batch (B, n, ...): whether two components beat one, and the side of each point."""
    one = w[:, :, None]
    mu, var, _ = _maximise(x, m, one, noise)
    mu1, var1 = np.nan_to_num(mu), var
    l1 = (_log_density(x, m, mu, var, mu1, var1)[:, :, 0] * w).sum(1)
    live = w > 0
    # two far points as the first means
    far = ((x - mu1) ** 2 * m / PRIOR_VARIANCE).sum(2)
    far[~live] = -1
    b = np.arange(len(x))
    i = far.argmax(1)
    d = ((x - x[b, i][:, None]) ** 2 * m * m[b, i][:, None] / PRIOR_VARIANCE).sum(2)
    d[~live] = -1
    j = d.argmax(1)
    e = ((x - x[b, j][:, None]) ** 2 * m * m[b, j][:, None] / PRIOR_VARIANCE).sum(2)
    near = np.where(d == e, 0.5, d < e).astype(np.float32)
    near[b, i], near[b, j] = 1, 0
    r = np.stack([near, 1 - near], 2) * one
    for _ in range(EM_ROUNDS):
        mu, var, share = _maximise(x, m, r, noise)
        ll = _log_density(x, m, mu, var, mu1, var1) + np.log(np.maximum(share, 1e-9))[:, None, :]
        top = ll.max(2)
        p = np.exp(ll - top[:, :, None])
        total = p.sum(2)
        r = p / total[:, :, None] * one
    l2 = ((top + np.log(total)) * w).sum(1)
    # parameters of one more component: its means where something is observed, and its share
    extra = (np.einsum("bn,bnd->bd", w, m) > 0).sum(1) + 1
    side = r[:, :, 1] > r[:, :, 0]
    both = (side & live).any(1) & (~side & live).any(1)
    return (2 * (l2 - l1) > _penalty(extra, w.sum(1))) & both, side


def fit_blocks(block: np.ndarray, x: np.ndarray, seen: np.ndarray, weight: np.ndarray, noise: np.ndarray | None = None, budget: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(component, density) of each point, components numbered within all blocks; ``block``: integers, sorted; ``noise``: of each point's block."""
    noise = np.ones(len(block)) if noise is None else noise
    m = seen.astype(np.float32)
    w = _weights(weight)
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.array([], int)
    queue = [np.arange(a, b) for a, b in zip(edges, np.r_[edges[1:], len(block)])]
    done: list[np.ndarray] = []
    while queue:
        sizes = np.array([len(q) for q in queue])
        done += [q for q in queue if len(q) == 1]
        classes = np.where(sizes > 1, np.ceil(np.log2(np.maximum(sizes, 2))).astype(int), 0)
        nxt: list[np.ndarray] = []
        for c in np.unique(classes[classes > 0]):
            members = [queue[k] for k in np.flatnonzero(classes == c)]
            width = max(len(q) for q in members)
            step = max(1, budget // (width * DIMS))
            for s in range(0, len(members), step):
                part = members[s : s + step]
                idx = np.zeros((len(part), width), int)
                live = np.zeros((len(part), width), np.float32)
                for k, q in enumerate(part):
                    idx[k, : len(q)], live[k, : len(q)] = q, 1
                mm = m[idx] * live[:, :, None]
                split, side = _try_split(x[idx], mm, w[idx] * live, noise[idx[:, 0]])
                for k, q in enumerate(part):
                    if split[k]:
                        right = side[k, : len(q)]
                        nxt += [q[~right], q[right]]
                    else:
                        done.append(q)
        queue = nxt
    label = np.zeros(len(block), np.int64)
    density = np.zeros(len(block))
    for k, q in enumerate(sorted(done, key=lambda q: q[0])):
        label[q] = k
    order = np.argsort(label, kind="stable")
    starts = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]]) if len(label) else np.array([], int)
    if len(label):
        xo, mo, wo = x[order], m[order], w[order][:, None]
        n = np.add.reduceat(mo * wo, starts)
        mean = np.add.reduceat(mo * xo * wo, starts) / np.maximum(n, 1e-6)
        size = np.diff(np.r_[starts, len(label)])
        var = (np.maximum(np.add.reduceat(mo * xo * xo * wo, starts) - n * mean * mean, 0) + PRIOR_WEIGHT * PRIOR_VARIANCE) / (n + PRIOR_WEIGHT)
        mu, v = np.repeat(mean, size, 0), np.repeat(var, size, 0)
        # per observed column, so that records with more fields are not denser or thinner for that
        density[order] = (-0.5 * (((xo - mu) ** 2 / v + np.log(v) + _LOG_2PI) * mo).sum(1)) / np.maximum(mo.sum(1), 1)
    return label, density


# -- the mixture of a block that no task can hold ----------------------------

_POINTS = "point long, block string, id long, has_place boolean, has_code boolean, weight long, x binary"


def _weights(weight: np.ndarray) -> np.ndarray:
    return (1 + np.log(np.maximum(weight, 1))).astype(np.float32)


def _arrays(pdf: pd.DataFrame, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, observed, weight) of points."""
    x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(-1, DIMS)
    m = np.ones((len(pdf), DIMS), np.float32)
    m[:, kept:KEPT_DIMS] = 0
    m[:, KEPT_DIMS : KEPT_DIMS + ANCHOR_DIMS] = pdf["has_place"].to_numpy(np.float32)[:, None]
    m[:, KEPT_DIMS + ANCHOR_DIMS :] = pdf["has_code"].to_numpy(np.float32)[:, None]
    return x, m, _weights(pdf["weight"].to_numpy())


@dataclass
class _Node:
    """What is known of a node while its points are split in passes over the table; the arrays are as in _try_split."""

    one: tuple[np.ndarray, ...] = ()  # mean, variance, share of one component
    observed: int = 0  # columns with an observation
    n: float = 0.0
    l1: float = 0.0
    far: tuple[tuple[int, np.ndarray, np.ndarray], ...] = ()  # id, values, observed of the two far points
    two: tuple[np.ndarray, ...] = ()

    def shares(self, ids: np.ndarray, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log density, responsibilities) under two components; by the distance to the far points before there are any."""
        if not self.two:
            (i, xi, mi), (j, xj, mj) = self.far
            d, e = (((x - y) ** 2 * m * o / PRIOR_VARIANCE).sum(1) for y, o in ((xi, mi), (xj, mj)))
            near = np.where(ids == i, 1, np.where(ids == j, 0, np.where(d == e, 0.5, d < e))).astype(np.float32)
            return np.zeros(len(x)), np.stack([near, 1 - near], 1)
        mean, var, share = self.two
        mu1, var1, _ = self.one
        ll = (_log_density(x[None], m[None], mean, var, np.nan_to_num(mu1), var1) + np.log(np.maximum(share, 1e-9))[:, None, :])[0]
        top = ll.max(1)
        p = np.exp(ll - top[:, None])
        return top + np.log(p.sum(1)), p / p.sum(1, keepdims=True)


def _only(points: DataFrame, names: Collection[str]) -> DataFrame:
    """Points of some blocks; with very many of them the tasks choose on their own, since a plan can't hold the list."""
    return points.where(F.col("block").isin(list(names))) if len(names) <= 1000 else points


def _sweep(points: DataFrame, nodes: dict[str, _Node], what: str, red: Reduction) -> dict[str, tuple[np.ndarray, tuple[float, int, np.ndarray, np.ndarray] | None]]:
    """Per node the sums over its points that a step needs, and its farthest point; the driver gets one row per task and node."""

    def step(node: _Node, ids: np.ndarray, x: np.ndarray, m: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        if what == "one" or what == "two":
            r = (w[:, None] if what == "one" else node.shares(ids, x, m)[1] * w[:, None]).astype(np.float64)
            return np.concatenate([(r.T @ m).ravel(), (r.T @ (m * x)).ravel(), (r.T @ (m * x * x)).ravel(), r.sum(0)]), None
        if what == "gain":
            ll, r = node.shares(ids, x, m)
            side = r[:, 1] > r[:, 0]
            return np.array([(ll * w).sum(dtype=np.float64), side.sum(), (~side).sum()]), None
        mu, var, _ = node.one
        if what == "far":
            flat = np.nan_to_num(mu)
            ll = _log_density(x[None], m[None], mu, var, flat, var)[0, :, 0]
            return np.array([(ll * w).sum(dtype=np.float64)]), ((x - flat[0]) ** 2 * m / PRIOR_VARIANCE).sum(1)
        _, xi, mi = node.far[0]
        return np.zeros(1), ((x - xi) ** 2 * m * mi / PRIOR_VARIANCE).sum(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        best: dict[str, tuple] = {}
        for pdf in batches:
            for name, g in pdf.groupby("block"):
                if name not in nodes:
                    continue
                ids = g["id"].to_numpy()
                x, m, w = _arrays(g, red.kept)
                total, distance = step(nodes[name], ids, x, m, w)
                sums[name] = sums[name] + total if name in sums else total
                if distance is not None:
                    k = np.lexsort((ids, -distance))[0]
                    found = (-float(distance[k]), int(ids[k]), x[k].tobytes(), m[k].tobytes())
                    best[name] = min(best.get(name, found), found)
        rows = [(n, v.astype(np.float64).tobytes(), *best.get(n, (0.0, 0, b"", b""))) for n, v in sums.items()]
        yield pd.DataFrame(rows, columns=["block", "sums", "d", "id", "x", "m"])

    out: dict = {}
    for r in _only(points, nodes).mapInPandas(run, "block string, sums binary, d double, id long, x binary, m binary").collect():
        total, far = np.frombuffer(r["sums"]), (r["d"], r["id"], bytes(r["x"]), bytes(r["m"]))
        out[r["block"]] = (out[r["block"]][0] + total, min(out[r["block"]][1], far)) if r["block"] in out else (total, far)
    return out


def _parameters(sums: np.ndarray, parts: int, noise: float) -> tuple[np.ndarray, ...]:
    rm, total, square = sums[:-parts].reshape(3, 1, parts, DIMS)
    return tuple(a.astype(np.float32) for a in _from_sums(rm, total, square, sums[-parts:][None], np.array([noise])))


def split_nodes(points: DataFrame, largest: int, red: Reduction) -> tuple[DataFrame, dict[str, _Node]]:
    """points with the nodes of their mixture that hold at most ``largest`` of them as blocks, and the larger nodes that no split improves.

    The same splits as in fit_blocks; the statistics are summed over tasks and
    the points stay where they are.
    """
    whole: dict[str, _Node] = {}
    while True:
        big = [r["block"] for r in points.groupBy("block").count().where(F.col("count") > largest).collect() if r["block"] not in whole]  # one for each ``largest`` points
        if not big:
            return points, whole
        nodes = {b: _Node() for b in big}
        for b, (sums, _) in _sweep(points, nodes, "one", red).items():
            nodes[b].one, nodes[b].observed, nodes[b].n = _parameters(sums, 1, red.of_block(b)), int((sums[:DIMS] > 0).sum()), float(sums[-1])
        for what in ("far", "other"):
            for b, (sums, (_, i, x, m)) in _sweep(points, nodes, what, red).items():
                nodes[b].l1 += float(sums[0])
                nodes[b].far += ((i, np.frombuffer(x, np.float32), np.frombuffer(m, np.float32)),)
        for _ in range(EM_ROUNDS):
            for b, (sums, _) in _sweep(points, nodes, "two", red).items():
                nodes[b].two = _parameters(sums, 2, red.of_block(b))
        split = {}
        for b, (sums, _) in _sweep(points, nodes, "gain", red).items():
            if 2 * (sums[0] - nodes[b].l1) > _penalty(nodes[b].observed + 1, nodes[b].n) and sums[1] and sums[2]:
                split[b] = nodes[b]
            else:
                whole[b] = nodes[b]
        if split:
            points = _divide(points, split, red)


def _divide(points: DataFrame, split: dict[str, _Node], red: Reduction) -> DataFrame:
    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            block = pdf["block"].to_numpy(object).copy()
            for name, at in pdf.groupby("block").indices.items():
                if name in split:
                    g = pdf.iloc[at]
                    x, m, _ = _arrays(g, red.kept)
                    r = split[name].shares(g["id"].to_numpy(), x, m)[1]
                    block[at] = [f"{name}/{int(s)}" for s in r[:, 1] > r[:, 0]]
            yield pdf.assign(block=block)

    return cut_table(points.mapInPandas(sides, _POINTS))


def _fit_points(points: DataFrame, largest: int, red: Reduction) -> DataFrame:
    """point, cluster_id, density of the different points of hot blocks."""
    schema = "point long, cluster_id long, density double"
    points, whole = split_nodes(points, largest, red)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x, m, _ = _arrays(pdf, red.kept)
        label, density = fit_blocks(np.zeros(len(pdf), int), x, m > 0, pdf["weight"].to_numpy(), np.full(len(pdf), red.of_block(pdf["block"].iloc[0])))
        return pd.DataFrame({"point": pdf["point"], "cluster_id": pdf["id"].groupby(label).transform("min"), "density": np.round(density, 6)})

    if not whole:
        return points.groupBy("block").applyInPandas(fit, schema)
    first = {r["block"]: r["id"] for r in _only(points, whole).groupBy("block").agg(F.min("id").alias("id")).collect()}

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, g in pdf.groupby("block"):
                if name not in whole:
                    continue
                x, m, _ = _arrays(g, red.kept)
                mu, v, _ = whole[name].one
                d = (-0.5 * (((x - np.nan_to_num(mu[0])) ** 2 / v[0] + np.log(v[0]) + _LOG_2PI) * m).sum(1)) / np.maximum(m.sum(1), 1)
                yield pd.DataFrame({"point": g["point"], "cluster_id": first[name], "density": np.round(d.astype(float), 6)})

    named = points.sparkSession.createDataFrame([(b,) for b in sorted(whole)], "block string")  # one for each ``largest`` points
    rest = points.join(named, "block", "left_anti").groupBy("block").applyInPandas(fit, schema)
    return rest.unionByName(_only(points, whole).mapInPandas(dense, schema))


# -- operators --------------------------------------------------------------

_PARSED = "key string, n_chars int, component string, place string, code string, text_hash long, wordless boolean, words binary"
UNANCHORED = "t:"  # the block of records without a component, place or code


def parse_records(records: DataFrame, lists: Lists) -> DataFrame:
    """key, n_chars, anchors, hash of the folded text and word features of (key, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = WordFeatures()
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            parsed = [parse(t, lists) for t in texts]
            v = np.clip(np.rint(vectors.of([p[3] for p in parsed]) * SCALE), -127, 127).astype(np.int8)
            folded = [" ".join(p[3]) if not (p[0] or p[1] or p[2]) else "" for p in parsed]
            yield pd.DataFrame({
                "key": pdf["key"], "n_chars": np.array([len(t) for t in texts], np.int32), "component": [p[0] for p in parsed], "place": [p[1] for p in parsed], "code": [p[2] for p in parsed],
                "text_hash": np.array([xxhash.xxh3_64_intdigest(f or t.strip()) for f, t in zip(folded, texts)], np.uint64).view(np.int64), "wordless": [not p[3] for p in parsed], "words": [r.tobytes() for r in v],
            })

    return records.select("key", "text").mapInPandas(run, _PARSED)


def _sums(pieces: DataFrame) -> np.ndarray:
    """(WORD_DIMS + 2) x WORD_DIMS: products, sums and, in the last row, counts; that is all the driver gets."""
    out = np.zeros((WORD_DIMS + 2, WORD_DIMS))
    for r in pieces.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"]
    return out


def _piece(products: np.ndarray, total: np.ndarray, n: float) -> pd.DataFrame:
    s = np.vstack([products, total, np.full(WORD_DIMS, n)])
    i, j = np.indices(s.shape)
    return pd.DataFrame({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "s": s.ravel()})


def _vectors(words: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.int8).reshape(-1, WORD_DIMS) / SCALE


def learn_reduction(parsed: DataFrame, hot: list[str], least_freedom: int = 20) -> Reduction:
    """Standardisation and projection of the word features, from all records.

    Records of a component's block that names no two different codes are about
    one job, whether they name the component or follow its place and code: how
    they differ is wording.  Their covariance is the scale, so that the
    directions kept are those in which jobs differ.  With fewer than
    ``least_freedom`` degrees of freedom for that, the directions of most
    variance are taken.  Equal records of a component count once in the
    covariance; those of a ``hot`` component are summed over all tasks.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, products, n = np.zeros(WORD_DIMS), np.zeros((WORD_DIMS, WORD_DIMS)), 0
        for pdf in batches:
            v = _vectors(pdf["words"])
            total, products, n = total + v.sum(0), products + v.T @ v, n + len(v)
        yield _piece(products, total, n)

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        products, freedom = np.zeros((WORD_DIMS, WORD_DIMS)), 0.0
        rest: pd.DataFrame | None = None

        def add(pdf: pd.DataFrame) -> None:
            nonlocal products, freedom
            pdf = pdf.drop_duplicates(ignore_index=True)
            group = pd.factorize(pdf["block"])[0]
            code = pdf["code"].fillna("")
            named = pdf[code != ""].groupby("block")["code"].nunique()
            keep = ~pdf["block"].isin(named.index[named > 1]).to_numpy()
            size = np.bincount(group, minlength=1)
            keep &= size[group] > 1
            if not keep.any():
                return
            v, g = _vectors(pdf["words"][keep]), pd.factorize(group[keep])[0]
            n = np.bincount(g).astype(float)
            sums = np.zeros((len(n), WORD_DIMS))
            np.add.at(sums, g, v)
            mean = sums / np.sqrt(n)[:, None]
            products = products + v.T @ v - mean.T @ mean
            freedom += float(len(v) - len(n))

        for pdf in batches:  # sorted by block; a block is bounded, its last rows may come with the next batch
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if len(pdf):
                open_ = pdf["block"] == pdf["block"].iloc[-1]
                rest = pdf[open_]
                add(pdf[~open_])
        if rest is not None:
            add(rest)
        yield _piece(products, np.zeros(WORD_DIMS), freedom)

    def hot_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        products, sums = np.zeros((WORD_DIMS, WORD_DIMS)), {}
        for pdf in batches:
            v = _vectors(pdf["words"])
            products = products + v.T @ v
            for block, at in pdf.groupby("block").indices.items():
                n, total = sums.get(block, (0, 0))
                sums[block] = n + len(at), total + v[at].sum(0)
        yield _piece(products, np.zeros(WORD_DIMS), 0).assign(block="")
        for block, (n, total) in sums.items():
            yield pd.DataFrame({"i": np.int32(WORD_DIMS), "j": np.arange(WORD_DIMS + 1, dtype=np.int32), "s": np.r_[total, n], "block": block})

    kind = "i int, j int, s double"
    everything = _sums(parsed.select("words").mapInPandas(moments, kind))
    named = parsed.where("block like 'c:%'").select("block", "code", "words")
    usual = named.where(~F.col("block").isin(hot)) if hot else named
    inside = _sums(usual.repartition("block").sortWithinPartitions("block").mapInPandas(scatter, kind))
    if hot:
        many = named.where(F.col("block").isin(hot)).distinct()
        alike = [r["block"] for r in many.groupBy("block").agg(F.min("code").alias("a"), F.max("code").alias("b")).collect() if r["a"] == r["b"]]
        products, blocks = np.zeros((WORD_DIMS, WORD_DIMS)), {b: np.zeros(WORD_DIMS + 1) for b in alike}
        for r in many.where(F.col("block").isin(alike)).mapInPandas(hot_sums, f"{kind}, block string").groupBy("block", "i", "j").agg(F.sum("s").alias("s")).collect():
            if r["block"]:
                blocks[r["block"]][r["j"]] = r["s"]
            elif r["i"] < WORD_DIMS:
                products[r["i"], r["j"]] = r["s"]
        for v in blocks.values():
            products = products - np.outer(v[:-1], v[:-1]) / v[-1]
            inside[-1] += v[-1] - 1
        inside[:WORD_DIMS] += products
    freedom = inside[-1, 0]
    return Reduction.of(everything[-1, 0], everything[-2], everything[:-2], inside[:-2] / freedom if freedom >= least_freedom else None)


def _own_block() -> Column:
    anchors = F.concat(F.lit("p:"), F.coalesce("place", F.lit("")), F.lit("|"), F.coalesce("code", F.lit("")))
    bare = F.when(F.col("wordless"), F.concat(F.lit("x:"), F.col("text_hash").cast("string"))).otherwise(F.lit(UNANCHORED))
    return F.coalesce(F.concat(F.lit("c:"), "component"), F.when(F.col("place").isNotNull() | F.col("code").isNotNull(), anchors), bare)


def mend_components(parsed: DataFrame, least_letters: int = 6, times: int = 3) -> DataFrame:
    """parsed, with a component whose name is one slip away from that of ``times`` as many records under that name.

    A slip is a letter more, less or other, or two letters changed over.  Names
    that are one slip apart share a form with at most one letter left out, so
    they meet in a join on such forms, not in pairs; how many names share a
    form is bounded by the alphabet.  Of several names the most usual one
    counts, then the smaller.
    """
    names = parsed.where("component is not null").groupBy("component").agg(F.count("*").alias("n"))
    names = names.select("component", "n", F.substring_index("component", "-", -1).alias("kind"), F.expr("left(component, length(component) - length(substring_index(component, '-', -1)) - 1)").alias("stem")).where(F.length("stem") >= least_letters)
    names = cut_table(names)
    short = F.transform(F.sequence(F.lit(1), F.length("stem")), lambda i: F.concat(F.left("stem", i - 1), F.substring("stem", i + 1, F.length("stem"))))
    form = F.explode(F.array_distinct(F.concat(F.array("stem"), short)))
    forms = lambda df, side: df.select(F.col("component").alias(f"c{side}"), F.col("stem").alias(f"s{side}"), F.col("n").alias(f"n{side}"), form.alias("form"), "kind")
    a, b = forms(names, "a"), forms(names.where(F.col("n") >= times), "b")
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    near = F.levenshtein("sa", "sb")
    one_slip = (near <= 1) | ((near == 2) & (letters(F.col("sa")) == letters(F.col("sb"))))
    pairs = a.join(b, ["kind", "form"]).where((F.col("ca") != F.col("cb")) & (F.col("nb") >= times * F.col("na")) & one_slip)
    meant = cut_table(pairs.groupBy(F.col("ca").alias("component")).agg(F.min_by("cb", F.struct(-F.col("nb"), "cb")).alias("meant")))
    return parsed.join(small(meant), "component", "left").withColumn("component", F.coalesce("meant", "component")).select(*parsed.columns)


def hot_blocks(blocked: DataFrame, largest: int) -> list[str]:
    """Blocks of more than ``largest`` records: at most one for each ``largest`` rows."""
    return sorted(r["block"] for r in blocked.groupBy("block").count().where(F.col("count") > largest).collect())


def assign_blocks(parsed: DataFrame) -> DataFrame:
    """parsed with ``block``: the component that most records of the same place and code name, else the record's own.

    The smaller name wins a tie.  Records without any anchor are in one block,
    those without words in that of their text.  Only records without a component, and those whose
    component lost a vote, have to look one up.
    """
    votes = parsed.where("place is not null and code is not null and component is not null").groupBy("place", "code", "component").agg(F.count("*").alias("n"))
    best = W.partitionBy("place", "code").orderBy(F.desc("n"), "component")
    votes = votes.withColumn("winner", F.first("component").over(best))
    winner = votes.where("component = winner").select("place", "code", "winner")
    lost = votes.where("component <> winner").select("place", "code", "component", "winner")
    seeking = F.col("component").isNull() & F.col("place").isNotNull() & F.col("code").isNotNull()
    named, unnamed, rest = parsed.where("component is not null"), parsed.where(seeking), parsed.where(F.col("component").isNull() & ~seeking)
    found = named.join(lost, ["place", "code", "component"], "left").select(*parsed.columns, "winner").unionByName(unnamed.join(winner, ["place", "code"], "left").select(*parsed.columns, "winner"))
    found = found.unionByName(rest.withColumn("winner", F.lit(None).cast("string")))
    return found.withColumn("block", F.coalesce(F.concat(F.lit("c:"), "winner"), _own_block())).drop("winner")


def _fit(pdf: pd.DataFrame, reduction: Reduction) -> tuple[np.ndarray, np.ndarray]:
    """(component, density) of records sorted by block; equal records are fitted once, with their number as weight."""
    words = _vectors(pdf["words"]).astype(np.float32)
    x, seen = features(list(pdf["place"]), list(pdf["code"]), words, reduction)
    return fit_blocks(pd.factorize(pdf["block"])[0], x, seen, pdf["weight"].to_numpy(), pdf["block"].map(reduction.of_block).to_numpy(float))


def cluster_records(records: DataFrame, rows_per_task: int = 40_000, lists: Lists | None = None, largest: int = 200_000) -> DataFrame:
    """key, n_chars, cluster_id, density of every record of (key, text): the mixture component it belongs to.

    Records of equal features are fitted once, with their number as weight,
    and get the same component.  Null and empty texts are one cluster; texts
    without any word (signs, emoji) are with their equals.  Keys are taken as they are: repeated keys are
    records of their own, null keys are kept.  An empty table gives no rows.

    A task takes whole blocks.  A block of more than ``largest`` records comes
    to it as its different records only, and its records look their component
    up; with more than ``largest`` different records it is split by passes over
    all tasks until its parts are small enough.  The mixture is the same.
    """
    records = cut_table(records.select("key", "text"))  # read for the lists and for the features
    if lists is None:
        lists = Lists(*learn_lists(records))
    parsed = mend_components(cut_table(parse_records(records, lists)))
    blocked = cut_table(assign_blocks(parsed).select("key", "n_chars", "block", "place", "code", "words"))
    hot = hot_blocks(blocked, largest)
    reduction = learn_reduction(blocked, hot)
    tasks = max(8, -(-blocked.count() // rows_per_task))
    schema = "key string, n_chars int, cluster_id long, density double"

    def ids(pdf: pd.DataFrame) -> np.ndarray:
        same = pdf[["block", "place", "code", "words"]].itertuples(index=False)
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join([b.encode(), (p or "").encode(), (c or "").encode(), w])) for b, p, c, w in same], np.uint64).view(np.int64)

    def identify(pdf: pd.DataFrame) -> pd.DataFrame:
        # the id of a component is the smallest hash of its different records: the same in any layout of the tasks
        pdf = pdf.sort_values(["block", "id"], ignore_index=True)
        label, density = _fit(pdf, reduction)
        return pdf.assign(cluster_id=pdf["id"].groupby(label).transform("min"), density=np.round(density, 6))

    def fit_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        same = ["block", "place", "code", "words"]
        group = pdf.groupby(same, dropna=False, sort=False).ngroup().to_numpy()
        first = pd.DataFrame({"g": group}).drop_duplicates().index
        one = pdf.iloc[first][same].assign(g=group[first], weight=np.bincount(group)[group[first]])
        one["id"] = ids(one)
        done = identify(one).set_index("g").loc[group]
        return pd.DataFrame({"key": pdf["key"], "n_chars": pdf["n_chars"], "cluster_id": done["cluster_id"].to_numpy(), "density": done["density"].to_numpy()})

    task = F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("int")
    usual = blocked.where(~F.col("block").isin(hot)) if hot else blocked
    out = usual.select("key", "n_chars", "block", "place", "code", "words", task.alias("task")).groupBy("task").applyInPandas(fit_rows, schema)
    if not hot:
        return out

    def place_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, _ = features(list(pdf["place"]), list(pdf["code"]), _vectors(pdf["words"]).astype(np.float32), reduction)
            yield pdf[["point", "block", "weight"]].assign(id=ids(pdf), has_place=pdf["place"].notna(), has_code=pdf["code"].notna(), x=[r.tobytes() for r in x])[[c.split()[0] for c in _POINTS.split(", ")]]

    many = blocked.where(F.col("block").isin(hot)).withColumn("point", F.xxhash64("block", F.coalesce("place", F.lit("")), F.coalesce("code", F.lit("")), "words"))
    points = many.groupBy("point").agg(*[F.first(c).alias(c) for c in ("block", "place", "code", "words")], F.count("*").alias("weight"))
    fitted = _fit_points(cut_table(points.mapInPandas(place_points, _POINTS)), largest, reduction)
    return out.unionByName(many.select("key", "n_chars", "point").join(fitted, "point").drop("point"))


def describe_clusters(members: DataFrame, typical: int = 3) -> DataFrame:
    """cluster_id, n_members, typical_keys, top_density: size and the members of the highest density, ties by key.

    Per cluster only ``typical`` rows are kept on the way, so its size is of no matter.
    """
    salted = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    best = W.partitionBy("cluster_id", "salt").orderBy(F.desc("density"), F.col("key").asc_nulls_last())
    part = salted.withColumn("rn", F.row_number().over(best)).groupBy("cluster_id", "salt").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("rn") <= typical, F.struct((-F.col("density")).alias("d"), "key"))).alias("top"))
    sized = part.groupBy("cluster_id").agg(F.sum("n").alias("n_members"), F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, typical).alias("top"))
    return sized.select("cluster_id", "n_members", F.transform("top", lambda t: t["key"]).alias("typical_keys"), F.round(-F.element_at("top", 1)["d"], 6).alias("top_density"))
