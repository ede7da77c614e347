import re
import re._parser as sre

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm.license_rules import BASE, rules
from marketloom.llm.licenses import license_report, scan, scanned, suppressed

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def sample(pattern, most):
    """A text that a pattern matches: every optional part taken, or none; every first alternative."""
    def of(parsed):
        out = ""
        for op, arg in parsed:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "IN":
                out += "7" if any(str(o) == "CATEGORY" for o, _ in arg) else chr(arg[0][1])
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                out += of(inner) * (1 if most and high == 1 else max(low, 1) if most else low)
            elif kind == "BRANCH":
                out += of(arg[1][-1 if most else 0])
            elif kind == "SUBPATTERN":
                out += of(arg[3])
            elif kind not in ("ASSERT", "ASSERT_NOT", "AT"):
                raise ValueError(kind)
        return out

    return of(sre.parse(pattern.pattern.decode()))


def brute_base(text):
    words = WORD.findall((text or "").translate(UPPER))
    places = [
        (i, label) for phrase, label in BASE for i in range(len(words))
        if words[i:i + len(phrase.split())] == phrase.split()
    ]
    return len(words), places


def brute(text):
    """All rules on the words, without prefilter, and suppression by comparing all pairs."""
    n, places = brute_base(text)
    plain = " " + "".join(w + " " for w in WORD.findall((text or "").translate(UPPER)))
    raw = plain.encode()
    hits = []
    for rule in rules():
        for m in rule.pattern.finditer(raw):
            hits.append((raw[:m.start()].count(b" "), raw[:m.end()].count(b" "), rule.priority, rule.order, rule.label))

    def outranks(x, y):
        return (x[2], x[1] - x[0], -x[3]) > (y[2], y[1] - y[0], -y[3])

    labels = {label for _, label in places} | {
        h[4] for h in hits if not any(
            x[0] <= h[0] and h[1] <= x[1] and outranks(x, h) for x in hits + [
                (a, a + len(p.split()), 2, -1, label) for p, label in BASE for a, b in places if b == label
            ]
        )
    }
    starts = [a for a, _ in places]
    return (n, len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)))


TEXTS = [
    "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "under the MIT\tlicense under the-mit-LICENSE",
    "This work is licensed under the GNU General Public License, version 3.", "mit freundlichen Gruessen, by cc",
    "Licensed under the Apache License, Version 2.0.", "cc by nc cc by nc by nc", "CC BY-NC-SA 4.0 and cc-by-nc-nd",
    "SPDX-License-Identifier: LGPL-2.1-or-later\nCopyright", "GNU Lesser General Public License v2.1", "apache license version 2x",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Ünder the mit license", "public domain works", "He spoke of the public domain and of a permission.", "underthe mit license",
]


@pytest.mark.parametrize("most", [False, True])
def test_every_rule_is_reached_through_the_prefilter(most):
    for rule in rules():
        text = sample(rule.pattern, most)
        assert rule.pattern.search((text + " ").encode()), rule.name
        assert any(h["rule"] == rule.name for h in scan(text.encode())[1]), rule.name


def test_many_rules_for_many_licences():
    found = rules()
    assert len(found) > 300 and len({r.label for r in found}) > 80
    assert len({r.name for r in found}) == len(found)


def test_report_equals_brute_force(spark, odd_docs):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, r[1]) for i, r in enumerate(odd_docs)]
    docs += [(200, " ".join(TEXTS)), (201, "\n".join(TEXTS[::-1]) * 3)]
    rows = license_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r[0]: tuple(r)[1:7] for r in rows} == {d: brute(t) for d, t in docs}
    assert all((r["score"] > 0) == bool(r["labels"]) and 0 <= r["score"] <= 1 for r in rows)


def test_contained_titles_are_suppressed():
    def labels(text):
        return sorted({h["label"] for h in scan(text.encode())[1] if h["kept"]})

    assert labels("the GNU Lesser General Public License, version 3") == ["lgpl-3"]
    assert labels("licensed under the GNU Affero General Public License version 3 or any later version") == ["agpl-3"]
    assert labels("Licensed under CC BY-NC-SA 4.0") == ["cc-by-nc", "cc-by-nc-sa"]  # the base phrase stays
    assert labels("Die Reise mit der Bahn, by bus, isc, python and ruby and curl") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(1, 6), st.integers(1, 3)), max_size=12))
def test_suppression_equals_comparing_all_pairs(intervals):
    start, size, priority = (np.array([i[k] for i in intervals], int) for k in range(3))
    order = np.arange(len(intervals))
    want = [
        any(a[0] <= b[0] and b[0] + b[1] <= a[0] + a[1] and (a[2], a[1], -i) > (b[2], b[1], -j)
            for i, a in enumerate(intervals))
        for j, b in enumerate(intervals)
    ]
    assert suppressed(start, start + size, priority, order).tolist() == want


def test_very_long_text_with_many_notices():
    text = ("word " * 50 + "Released under the MIT License. ") * 4000
    n, hits = scan(text.encode())
    assert n == 55 * 4000 and sum(h["base"] for h in hits) == 4000


def test_odd_tables(spark, odd_frame, empty_frame):
    rows = license_report(odd_frame)
    assert rows.count() == odd_frame.count()
    assert {tuple(r)[1:] for r in rows.filter("doc_id in (4, 5, 6)").collect()} == {(0, 0, None, None, "", "", 0.0)}
    assert license_report(empty_frame).columns == rows.columns and license_report(empty_frame).count() == 0
    assert scanned(empty_frame).count() == 0
