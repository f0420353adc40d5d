"""Decontamination against a plain reading of its definition, on planted and random texts."""

import random
import re
from collections import defaultdict

from stagewise.llm import decontamination as dc

UNITS = set(dc.UNITS)


def _words(text):
    """(template words, their values, plain words) of a text."""
    plain, kinds, end = [], [], 0
    for m in re.finditer(r"[0-9A-Za-z]+", text or ""):
        w, inside = m.group(), bool(plain) and not re.search(r"[\n!.?]", text[end : m.start()])
        low = w.lower()
        kinds.append("#" if w[0].isdigit() else "%" if low in UNITS else "@" if inside and re.match("[A-Z][a-z]", w) else "")
        plain.append(low)
        end = m.end()
    keep = [i for i, k in enumerate(kinds) if not (i and k == kinds[i - 1] == "#")]
    return [kinds[i] or plain[i] for i in keep], [(kinds[i], plain[i]) for i in keep], plain


def _windows(words, width):
    return {i: tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def _leaks(docs, items, coverage=dc.COVERAGE):
    found = {}
    for j, item in items.items():
        template, values, plain = _words(item)
        if not plain:
            continue
        slots = lambda v, at, n: tuple(x for k, x in v[at : at + n] if k)
        width = min(dc.WIDTH, len(template))
        own = {p: w for p, w in _windows(template, width).items() if width >= dc.LEAST_WIDTH and 2 * len(slots(values, p, width)) <= width}
        exact = _windows(plain, min(dc.WIDTH, len(plain)))
        for d, text in docs.items():
            t, v, p = _words(text)
            there = set(_windows(p, min(dc.WIDTH, len(plain))).values())
            if sum(w in there for w in exact.values()) >= coverage * len(exact):
                found[d, j] = True
            hits = [(place, at) for at, w in _windows(t, width).items() for place, mine in own.items() if w == mine]
            offsets, groups, near = sorted({a - b for b, a in hits}), defaultdict(list), {}
            for i, o in enumerate(offsets):
                near[o] = near[offsets[i - 1]] if i and o - offsets[i - 1] <= dc.TOLERANCE else o
            for place, at in hits:
                for name in ((0, at - place), (1, near[at - place]), (2, 0)):
                    groups[name].append((place, at))
            for members in groups.values():
                both = [(slots(values, a, width), slots(v, b, width), a) for a, b in members]
                pairs = {xy for x, y, _ in both for xy in zip(x, y)}
                one = len({x for x, _ in pairs}) == len(pairs)
                same = len({a for x, y, a in both if x == y}) >= coverage * len(own)
                if same or (one and len({a for _, _, a in both}) >= coverage * len(own)):
                    found[d, j] = found.get((d, j), False) or same
    return found


def test_against_the_definition(spark):
    rng = random.Random(31)
    pool = ["red", "blue", "take", "from", "with", "box", "then", "what", "is", "sum", "of", "the", "Ann", "Bob", "Eve", "Kent", "3", "17", "240", "kg", "miles", "hours"]
    make = lambda n: "".join(w + rng.choice([" "] * 8 + [". ", ", "]) for w in rng.choices(pool, k=n)).strip()
    items = {i: make(rng.randint(1, 30)) for i in range(25)} | {30: None, 31: "", 32: "12 14 16"}

    def changed(text):
        names, numbers = dict(zip(["Ann", "Bob", "Eve", "Kent"], rng.sample(["Joe", "Max", "Ida", "Kim"], 4))), {n: str(rng.randint(300, 900)) for n in ("3", "17", "240")}
        out = [rng.choice(pool) if rng.random() < rng.choice([0, 0, 0.2]) else names.get(w, numbers.get(w, w)) for w in text.split(" ")]
        return " ".join(out)

    docs = {}
    for d in range(120):
        item = items[rng.randrange(25)]
        parts = [make(rng.randint(0, 15)), rng.choice([item, item.upper(), changed(item), changed(item) + " " + changed(item), make(20)]), make(rng.randint(0, 15))]
        docs[d] = " ".join(parts)
    docs |= {200: None, 201: ""}
    got = dc.leaks(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3), spark.createDataFrame(list(items.items()), "item_id bigint, text string")).collect()
    expected = _leaks(docs, items)
    assert {(r.doc_id, r.item_id): r.exact for r in got} == expected
    assert any(expected.values()) and not all(expected.values())
