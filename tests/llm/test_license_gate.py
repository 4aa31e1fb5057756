"""Every way in which a license rule matches passes the gate, whatever stands between the words."""

import itertools
import re

import pyarrow as pa
import pyarrow.compute as pc

from seriesloom.llm import licenses


def test_every_rule_passes_the_gate():
    every = licenses.rules()
    pattern, ways, tried = licenses.gate(every), [], 0
    for rule in every:
        for way in sorted(licenses.shortest(re._parser.parse(rule.pattern.pattern))):
            for fill in itertools.product("c105s2x", repeat=way.count("\0")):  # characters for what is no literal
                text = way.replace("\0", "{}").format(*fill)
                if rule.pattern.search(f" {text} "):
                    ways.append(text)
                    break
        assert ways and rule.pattern.search(f" {ways[-1]} "), rule
        tried += 1
    assert tried == len(every)
    column = pa.array([w.upper().replace(" ", gap) for w in ways for gap in (" ", "\n * ", "://")])
    assert pc.all(pc.match_substring_regex(column, pattern, ignore_case=True)).as_py()


def test_addresses_and_broken_lines_are_labelled(spark):
    texts = [
        ("http://www.eclipse.org/legal/epl-v10.html", "epl-1.0"), ("https://joinup.ec.europa.eu/collection/eupl/eupl-text-eupl-12", "eupl-1.2"),
        ("https://mariadb.com/bsl11", "busl-1.1"), ("http://scripts.sil.org/OFL", "ofl-1.1"), ("http://www.zope.org/Resources/ZPL", "zpl-2.1"),
        ("under the same\n# terms as Perl itself", "perl"),
        ("Neither the\n * name of X nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
        ("no words of that kind", None),
    ]
    df = spark.createDataFrame([(t, x) for t, x in texts], "text string, label string")
    for r in licenses.scan(df, ["text", "label"]).collect():
        assert [d.label for d in r.found] == ([r.label] if r.label else []), r.text


def test_long_texts_of_many_hits_take_time_in_proportion():
    import time

    every = licenses.rules()
    line = lambda n: licenses.canonical("under the MIT license. Apache License, Version 2.0 and GPL v3 apply. " * n)
    small, large = line(500), line(15_000)  # the second has 1 MB
    t0 = time.time()
    licenses.detections(small, every)
    t1 = time.time()
    found, base = licenses.detections(large, every), licenses.base_places(large)
    assert len(base) == 30_000 and len(found) >= 30_000 and time.time() - t1 < 60 * max(0.25, t1 - t0)


def test_suppression_equals_a_look_at_all_pairs():
    import random

    rng = random.Random(3)
    for _ in range(300):
        held, slow, fast = [], [], licenses.Taken()
        for _ in range(40):
            a = rng.randrange(60)
            label, b = rng.choice("xyz"), a + rng.randrange(1, 12)
            free = not any(x <= a and b <= y or label == own and x < b and a < y for own, x, y in held)
            if free:
                held.append((label, a, b))
            slow.append(free)
            assert fast.add(label, a, b) == free
