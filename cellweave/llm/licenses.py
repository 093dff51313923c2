"""Licence scans with DataFrame expressions alone.

A text is cut into paragraphs at its blank lines. Units of a paragraph are its lines and, across lines, its words in
overlapping windows of two sizes: small ones, in which one notice stands almost alone, and some of two licence texts. A unit with a trigger word is scored by a
multinomial logistic regression on its words and word pairs: one class for each licence family and one for what names no
known licence. The model is trained on variants of the licences' texts and of sentences that name none; its chances are
calibrated by a temperature, and the chance from which a family counts is chosen, both on variants held out. Below it, a
unit is of the unknown class. A family counts only if the unit also holds enough of one of its texts.

A line that names several licences (``MIT OR Apache-2.0``) is also a unit for each of them, with the words before the first. A
name that the line denies ("is not licensed under") counts for nothing. What two licences share word for word is evidence for both:
the paragraphs around decide. "All rights reserved." of a copyright line counts only where no licence follows.

All work on documents is one projection: no shuffle, no join, no Python on executors, and nothing that depends on other
rows. Weights and texts are literals that the optimiser folds once; their number doesn't follow the corpus.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.license_texts import NAMES, OTHERS, SHARED, TEXTS

# Words of which every licence text has one, and without which nothing is scored.
TRIGGERS = ["license", "licence", "licensed", "licenced", "unlicense", "copyright", "permission", "warranty", "warranties", "redistribution", "redistributions", "reserved", "domain", "commons", "spdx", "wtfpl"]
NONE = "none"
#: Share of a text's word pairs that a unit must hold to confirm a family.
CONFIRM = 0.7
#: A text of fewer words must be held whole by a unit of several lines.
SHORT = 16
#: Words of a small window; it starts anew after half of them.
WINDOW = 48
#: Features are told apart by so many bits of their CRC-32.
BITS = 14
#: Paragraphs before and after that decide between licences which share a text, and in which a licence follows a copyright line.
NEAR = 12
# Word pairs that deny what follows, the words before licences in an expression, and what stands between these.
DENIALS = ["not licensed", "not licenced", "not released", "not covered", "not distributed", "not available", "not under", "never licensed", "never released", "longer licensed", "longer released", "longer under", "t licensed", "t released", "t under"]
BEFORE_NAMES = r"^(.*?\b(?:license-identifier:?|licen[sc]ed under(?: the| either| either the)?|released under(?: the| either)?|distributed under(?: the| either)?|available under(?: the| either)?|under the terms of(?: the| either)?))\s+(.*)$"
BETWEEN_NAMES = r"(?:\s+(?:or|and|with)\s+(?:the\s+)?|[()/,])+"
_ROUNDS, _RATE, _DECAY, _COPIES = 400, 1.0, 1e-3, 14


def _words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _pairs_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _grams(words: list[str]) -> list[str]:
    return sorted({*words, *_pairs_of(words)})


def _cell(gram: str) -> int:
    return zlib.crc32(gram.encode()) & ((1 << BITS) - 1)


def _number(*seed) -> int:
    return zlib.crc32("/".join(map(str, seed)).encode())


def _variant(text: str, k: int) -> list[str]:
    """The k-th variant of a text's words: other words around, some words lost or put in, a part of a longer text, other spelling."""
    words = _words(text)
    if len(words) >= 30 and k % 3 == 1:
        a = _number(text, k, "cut") % (len(words) // 3)
        words = words[a : a + 2 * len(words) // 3]
    if len(words) >= 10 and k % 4 >= 2:
        words = [w for i, w in enumerate(words) if _number(text, k, i) % 12 or w.isdigit()]
    if len(words) >= 20 and k % 4 == 1:
        words = [x for i, w in enumerate(words) for x in ([w, f"name{_number(text, k, i) % 99}"] if _number(k, text, i) % 15 == 0 else [w])]
    words = [w.replace("license", "licence") for w in words] if k % 5 == 4 else words
    some = [w for t in OTHERS for w in _words(t)]
    around = [some[_number(text, k, "around", i) % len(some)] for i in range((k * 5) % 8)]
    return [*around[::2], *words, *around[1::2]]


def _shuffled(text: str, k: int) -> list[str]:
    """A text's words in no order: they name no licence."""
    words = _words(text)
    return sorted(words[: len(words) // (1 + k % 2)], key=lambda w: _number(w, k))


class Model:
    """Weights of the features' cells for each class (the last: none), a temperature, and the chance from which a family counts."""

    def __init__(self, classes: list[str], features: list[str], weights: np.ndarray, offsets: np.ndarray, temperature: float, least: float):
        self.classes, self.features, self.weights, self.offsets, self.temperature, self.least = classes, features, weights, offsets, temperature, least

    def chances(self, units: list[list[str]]) -> np.ndarray:
        """The classes' chances for each unit's words; the plain form of what ``scan`` works out."""
        return _softmax((_bags(units, self.features) @ self.weights + self.offsets) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _bags(units: list[list[str]], features: list[str]) -> np.ndarray:
    known, x = set(features), np.zeros((len(units), 1 << BITS), np.float32)
    for k, words in enumerate(units):
        grams = [_cell(g) for g in _grams(words) if g in known]
        np.add.at(x[k], grams, 1)
    return x


@functools.lru_cache(maxsize=1)
def all_texts() -> dict[str, list[str]]:
    """Each family's texts: those that are printed, and its names as notices and expressions hold them."""
    made = lambda n: [f"Licensed under {n}.", f"Licensed under the {n}.", f"SPDX-License-Identifier: {n}", *([f"The {n} applies."] if n.endswith("License") else [])]
    out = {}
    for family, texts in TEXTS.items():
        named = [x for n in NAMES.get(family, []) for x in made(n)]
        known, more = {tuple(_words(t)) for t in texts}, []
        for x in named:
            if tuple(_words(x)) not in known:
                known.add(tuple(_words(x)))
                more.append(x)
        out[family] = [*texts, *more]
    return out


def _rows() -> list[tuple[str, list[str], int]]:
    """(class, words, number of the variant) to learn from and to calibrate with."""
    rows = [(family, _variant(t, k), k) for family, texts in all_texts().items() for t in texts for k in range(_COPIES)]
    rows += [(NONE, _variant(t, k), k) for t in OTHERS for k in range(_COPIES)]
    return rows + [(NONE, _shuffled(t, k), k) for texts in TEXTS.values() for t in texts if len(_words(t)) >= SHORT for k in range(4)]


@functools.lru_cache(maxsize=1)
def train() -> Model:
    """The model, the same on every run: a fifth of the variants is held out for the temperature and the least chance."""
    for t in [t for texts in all_texts().values() for t in texts]:
        if not set(TRIGGERS) & set(_words(t)):
            raise ValueError(f"a licence text without a trigger word: {t}")
    rows = _rows()
    classes = [*sorted(TEXTS), NONE]
    spoken = [g for texts in [*all_texts().values(), OTHERS] for t in texts for g in _grams(_words(t))]
    features = sorted({*spoken, *(g.replace("license", "licence") for g in spoken)})
    x = _bags([words for _, words, _ in rows], features)
    used = np.flatnonzero(x.any(0))
    x, y = x[:, used], np.array([classes.index(c) for c, _, _ in rows])
    held = np.array([k % 5 == 3 for _, _, k in rows])
    goal = np.eye(len(classes), dtype=np.float32)[y]
    # Classes weigh the same.
    weigh = (1 / np.bincount(y[~held], minlength=len(classes)).clip(1))[y[~held]][:, None].astype(np.float32)
    w, b = np.zeros((len(used), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    learnt, goal = x[~held], goal[~held]
    for _ in range(_ROUNDS):
        slope = (goal - _softmax(learnt @ w + b)) * weigh
        w += _RATE * (learnt.T @ slope - _DECAY * w)
        b += _RATE * slope.sum(0) * 0.1
    logits, own = x[held] @ w + b, y[held]
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(own)), own] + 1e-12).mean()
    temperature = min((0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0), key=loss)
    chance = _softmax(logits / temperature)
    right, known = chance[np.arange(len(own)), own], own < len(classes) - 1
    false = np.sort(np.where(known, 0, chance[:, :-1].max(1)))[::-1]
    # The least chance at which at most one in a hundred held-out units of the unknown class would count, but that halves of
    # a mixed paragraph still reach.
    least = float(np.clip(false[max(1, (~known).sum() // 100)], 0.1, 0.4))
    whole = np.zeros((1 << BITS, len(classes)))
    whole[used] = w
    model = Model(classes, features, np.round(whole, 4), np.round(b.astype(float), 4), float(temperature), round(least, 4))
    model.recall, model.false_alarms = float((right[known] >= least).mean()), float((chance[~known, :-1].max(1) >= least).mean())
    return model


def _literal(value, kind: str) -> Column:
    """A constant of any size as one literal, once the optimiser has folded it."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, "[^a-z0-9]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.size(words) > 1, F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(none)


_UNIT = "struct<paragraph:int,line:int,words:array<string>>"


def scan(docs: DataFrame, model: Model, text: str = "text", confirm: float = CONFIRM) -> DataFrame:
    """All columns with ``licenses`` (confirmed families, sorted, each once), ``paragraphs`` and ``unknown``.

    paragraphs: (paragraph, line, family, chance, overlap, confirmed) for each unit with a trigger word and each family of
    at least the model's least chance there. paragraph counts from 0; line is the line within it, or -1 for a window across lines;
    overlap is the greatest share of word pairs of one of the family's texts that the unit holds. A short text must be held
    whole where lines are taken together, so that pieces of two licences don't make a third; of two families that a paragraph would
    confirm on mostly the same pairs, the one whose text it holds more of is. A denied name is confirmed by no short text. A
    family whose texts are all ones that another shares is that other where the ``NEAR`` paragraphs around hold all of the
    other's and none of its own. unknown: paragraphs with a trigger word
    in which nothing is confirmed. A null or empty text has none. Each row is judged by its own text, so repeated rows are
    equal; the new columns replace those of their names.
    """
    docs = docs.drop("licenses", "paragraphs", "unknown")
    triggers = _literal(TRIGGERS, "array<string>")
    features = _literal(model.features, "array<string>")
    used = np.flatnonzero(model.weights.any(1))
    place = np.zeros(1 << BITS, int)
    place[used] = np.arange(1, len(used) + 1)
    rows = _literal([[0.0] * len(model.classes), *model.weights[used].tolist()], "array<array<double>>")
    place = _literal(place.tolist(), "array<int>")
    held_by = all_texts()
    texts = _literal([[{"n": n, "t": _pairs_of(_words(t)), "short": len(_words(t)) < SHORT} for n, t in enumerate(held_by[c])] for c in model.classes[:-1]], "array<array<struct<n:int,t:array<string>,short:boolean>>>")
    # Of a copyright line: "copyright c", "copyright 2019", "c 2019" and the like.
    copyrights = _literal(["copyright c", *(f"{w} {y}" for w in ("copyright", "c") for y in range(1970, 2100))], "array<string>")
    denials = _literal(DENIALS, "array<string>")
    names = _literal(model.classes, "array<string>")
    offsets = _literal(model.offsets.tolist(), "array<double>")
    reach = max(len(_words(t)) for family in held_by.values() for t in family)
    low = F.lower(F.col(f"`{text}`"))
    spoken = functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in sorted(TRIGGERS) if not any(o in t and o != t for o in TRIGGERS)])

    def units(paragraph: Column, k: Column) -> Column:
        lines = F.transform(F.split(paragraph, "\n"), lambda line, i: F.struct(k.alias("paragraph"), i.alias("line"), _tokens(line).alias("words")))
        # Of an expression, each licence with the words before the first.
        parts = F.transform(F.split(paragraph, "\n"), lambda line, i: F.struct(i.alias("line"), F.regexp_extract(line, BEFORE_NAMES, 1).alias("before"), F.split(F.regexp_extract(line, BEFORE_NAMES, 2), BETWEEN_NAMES).alias("names")))
        parts = F.filter(parts, lambda p: F.size(p["names"]) > 1)
        named = F.flatten(F.transform(parts, lambda p: F.transform(p["names"], lambda n: F.struct(k.alias("paragraph"), p["line"].alias("line"), F.concat(_tokens(p["before"]), _tokens(n)).alias("words")))))
        words = _tokens(paragraph)

        def windows(size: int) -> Column:
            starts = F.when(F.size(words) > size, F.sequence(F.lit(1), F.size(words), F.lit(size // 2))).otherwise(F.array(F.lit(1)))
            return F.transform(starts, lambda a: F.struct(k.alias("paragraph"), F.lit(-1).alias("line"), F.slice(words, a, F.lit(size)).alias("words")))

        small = F.when(F.size(words) > WINDOW, windows(WINDOW)).otherwise(F.array().cast(f"array<{_UNIT}>"))
        every = F.when(F.size(lines) > 1, F.concat(lines, named, windows(2 * reach), small)).otherwise(F.concat(lines, named, small))
        return F.filter(every, lambda u: F.arrays_overlap(u["words"], triggers))

    def paired(u: Column) -> Column:
        return F.struct(u["paragraph"].alias("paragraph"), u["line"].alias("line"), u["words"].alias("words"), _pairs(u["words"]).alias("pairs"))

    def scored(u: Column) -> Column:
        known = F.array_intersect(F.array_union(F.array_distinct(u["words"]), u["pairs"]), features)
        cells = F.transform(known, lambda g: F.get(place, F.crc32(g.cast("binary")).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))
        logits = F.aggregate(cells, offsets, lambda total, c: F.zip_with(total, F.get(rows, c), lambda a, b: a + b))
        return F.struct(u["paragraph"].alias("paragraph"), u["line"].alias("line"), u["pairs"].alias("pairs"), F.transform(logits, lambda x: x / model.temperature).alias("logits"))

    def chanced(u: Column) -> Column:
        top = F.array_max(u["logits"])
        parts = F.transform(u["logits"], lambda x: F.exp(x - top))
        return F.struct(u["paragraph"].alias("paragraph"), u["line"].alias("line"), u["pairs"].alias("pairs"), F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda s, y: s + y)).alias("chances"))

    def families(u: Column) -> Column:
        def judged(k: Column) -> Column:
            held = F.transform(F.get(texts, k), lambda t: F.struct((F.size(F.array_intersect(u["pairs"], t["t"])) / F.size(t["t"])).alias("share"), F.array_intersect(u["pairs"], t["t"]).alias("pairs"), t["short"].alias("short"), t["n"].alias("n")))
            denied = F.arrays_overlap(u["pairs"], denials)
            sure = F.filter(held, lambda h: (h["share"] >= F.when(h["short"] & (u["line"] < 0), 1.0).otherwise(confirm)) & ~(h["short"] & denied))
            enough = F.size(sure) > 0
            best = F.array_max(held)
            return F.struct(u["paragraph"].alias("paragraph"), u["line"].alias("line"), F.get(names, k).alias("family"), F.round(F.get(u["chances"], k), 6).alias("chance"), F.round(best["share"], 6).alias("overlap"), enough.alias("confirmed"), best["pairs"].alias("pairs"), F.transform(sure, lambda h: h["n"]).alias("texts"))

        counted = F.filter(F.sequence(F.lit(0), F.lit(len(model.classes) - 2)), lambda k: F.get(u["chances"], k) >= model.least)
        return F.transform(counted, judged)

    def decided(paragraph: Column) -> Column:
        """Of two families that a paragraph confirms on mostly the same pairs, the one whose text it holds more of."""
        found = paragraph["found"]
        sure = F.filter(found, lambda q: q["confirmed"])
        beaten = lambda p: F.exists(sure, lambda q: (q["overlap"] > p["overlap"]) & (2 * F.size(F.array_intersect(p["pairs"], q["pairs"])) > F.size(p["pairs"])))
        return F.transform(found, lambda p: F.struct(*[p[c].alias(c) for c in ("paragraph", "line", "family", "chance", "overlap")], (p["confirmed"] & ~beaten(p)).alias("confirmed"), p["texts"].alias("texts"), paragraph["signed"].alias("signed")))

    def settled(p: Column) -> Column:
        """By the paragraphs around: shared texts go to the licence that these complete, and a copyright line's reservation yields to a licence."""
        near = lambda places: F.exists(places, lambda k: F.abs(k - p["paragraph"]) <= NEAR)
        family, confirmed = p["family"], p["confirmed"]
        for i, (own, shared, other, _, _) in enumerate(SHARED):
            alone = F.size(F.array_except(p["texts"], _literal(_starting(own, shared), "array<int>"))) == 0
            whole = functools.reduce(lambda a, b: a & b, [near(F.col(f"_needs{i}")[j]) for j in range(len(SHARED[i][3]))])
            family = F.when((p["family"] == own) & alone & whole & ~near(F.col(f"_bars{i}")), other).otherwise(family)
        reserved = (p["family"] == "Proprietary") & p["signed"] & (F.size(F.array_except(p["texts"], _literal(_starting("Proprietary", ["All rights reserved."]), "array<int>"))) == 0)
        follows = F.exists("_licensed", lambda k: (k >= p["paragraph"]) & (k - p["paragraph"] <= NEAR))
        return F.struct(p["paragraph"].alias("paragraph"), p["line"].alias("line"), family.alias("family"), p["chance"].alias("chance"), p["overlap"].alias("overlap"), (confirmed & ~(reserved & follows)).alias("confirmed"))

    def places(test) -> Column:
        """The paragraphs of confirmed findings that pass a test."""
        return F.array_distinct(F.transform(F.filter("_found", lambda p: p["confirmed"] & test(p)), lambda p: p["paragraph"]))

    # Each step is a column of its own, so that a step's result isn't worked out once for every use. Units stay with their paragraph.
    none = F.array().cast(f"array<array<{_UNIT}>>")
    each = lambda f: F.transform("_units", lambda us: F.transform(us, f))
    cut = F.split(low, "\n(?:[^a-z0-9\n]*\n)+")
    out = docs.withColumn("_units", F.coalesce(F.when(spoken, F.filter(F.transform(cut, units), lambda us: F.size(us) > 0)), none))
    out = out.withColumn("_units", each(paired)).withColumn("_units", each(scored)).withColumn("_units", each(chanced))
    out = out.withColumn("_in", F.transform("_units", lambda us: us[0]["paragraph"]))
    out = out.withColumn("_found", F.transform("_units", lambda us: F.struct(F.exists(us, lambda u: F.arrays_overlap(u["pairs"], copyrights)).alias("signed"), F.flatten(F.transform(us, families)).alias("found")))).drop("_units")
    out = out.withColumn("_found", F.flatten(F.transform("_found", decided)))
    for i, (own, _, _, needs, bars) in enumerate(SHARED):
        holds = lambda p, start: (p["family"] == own) & F.arrays_overlap(p["texts"], _literal(_starting(own, start), "array<int>"))  # noqa: B023, E731
        out = out.withColumn(f"_needs{i}", F.array(*[places(lambda p, n=n: holds(p, [n])) for n in needs])).withColumn(f"_bars{i}", places(lambda p: holds(p, bars)))  # noqa: B023
    out = out.withColumn("_licensed", places(lambda p: p["family"] != "Proprietary"))
    out = out.withColumn("paragraphs", F.transform("_found", settled)).drop("_found", "_licensed", *[f"_{c}{i}" for i in range(len(SHARED)) for c in ("needs", "bars")])
    sure = F.filter("paragraphs", lambda p: p["confirmed"])
    out = out.withColumn("licenses", F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["family"]))))
    left = F.array_except("_in", F.transform(F.filter("paragraphs", lambda p: p["confirmed"]), lambda p: p["paragraph"]))
    return out.withColumn("unknown", F.size(left).cast("long")).drop("_in")


def _starting(family: str, starts: list[str]) -> list[int]:
    """The numbers of a family's texts that begin so."""
    return [n for n, t in enumerate(all_texts()[family]) if any(t.startswith(s) for s in starts)]
