import random

import pytest

from seqsieve.llm import licenses

SCANNER = licenses.Scanner(licenses.TEMPLATES)
APACHE_LONG, MIT_LONG = (t for _, t in licenses.TEMPLATES if len(t) > 400)


def filler(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "code", "under", "version", "and", "license", "of", "work", "public"]) for _ in range(n))


@pytest.mark.parametrize("name, text", licenses.TEMPLATES)
def test_every_template_is_found_exactly(name, text):
    body = f"{filler(1)}\n{text} {filler(2)}"
    assert [f[:4] for f in SCANNER.scan(body) if f[0] == name or f[3] == 0] == [(name, len(filler(1)) + 1, len(filler(1)) + 1 + len(text), 0)]


def test_wording_decides():
    words = MIT_LONG.split()
    few = words[:20] + words[22:60] + ["indeed"] + words[60:]
    assert [(f[0], f[3]) for f in SCANNER.scan(" ".join(few))] == [("MIT", 3)]
    many = [w if i % 4 else "else" for i, w in enumerate(words)]
    assert SCANNER.scan(" ".join(many)) == []
    assert [f[0] for f in SCANNER.scan("Licensed under CC BY-SA 4.0. and Licensed under CC BY 4.0.")] == ["CC-BY-SA-4.0", "CC-BY-4.0"]
    assert SCANNER.scan("Released under the BSD License.") == [] and SCANNER.scan("a license to thrill") == []


def test_fit_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        template = licenses.Template("t", " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))))
        block = [rng.choice("abc") for _ in range(rng.randrange(0, 7))]

        def distance(a, b):
            if not a or not b:
                return len(a) + len(b)
            return min(distance(a[1:], b[1:]) + (a[0] != b[0]), distance(a[1:], b) + 1, distance(a, b[1:]) + 1)

        parts = [block[i:j] for i in range(len(block) + 1) for j in range(i, len(block) + 1)]
        differing, start, end = template.fit(block)
        assert differing == min(distance(template.words, p) for p in parts) == distance(template.words, block[start:end])


def test_operator_edges(table):
    notice = "Released under the MIT License."
    rows = [(1, None, None, None), (2, "", "en", "s"), (None, f"x {notice}", "en", "s"), (4, notice, "en", "s"), (4, notice, "en", "s"), (5, "é " * 100_000 + APACHE_LONG + " license" * 20_000, "en", "s"), (6, f"{notice} {notice}", "en", "s")]
    got = sorted(map(tuple, licenses.report(licenses.scan_licenses(table(rows, clashing=True))).collect()), key=repr)
    want = [(1, 0, None, ""), (2, 0, None, ""), (None, 1, "MIT", "MIT:2:33:0"), (4, 1, "MIT", "MIT:0:31:0"), (4, 1, "MIT", "MIT:0:31:0")]
    want += [(5, 1, "Apache-2.0", f"Apache-2.0:200000:{200000 + len(APACHE_LONG)}:0"), (6, 2, "MIT", "MIT:0:31:0,MIT:32:63:0")]
    assert got == sorted(want, key=repr)
    assert licenses.scan_licenses(table([])).collect() == []
    with pytest.raises(ValueError):
        licenses.Scanner([("x", "no anchor here")])


def test_long_neighbours_hide_no_notice():
    for before, notice, after in [
        ("our work", "licensed under cc by 4.0", "https://creativecommons.org/licenses/by/4.0 see"),
        ("our code", "released under the mit license", "see https://github.com/somebody/something-long/blob/main/README.md"),
    ]:
        got = SCANNER.scan(f"{before} {notice} {after}")
        assert [f[1:4] for f in got] == [(len(before) + 1, len(before) + 1 + len(notice), 0)]


def test_other_wordings_and_other_licenses():
    scanner = licenses.Scanner(licenses.COMMON)
    for text, name in [
        ("Licensed under the MIT License", "MIT"), ("Licensed under the Apache License 2.0", "Apache-2.0"), ("Released under the MIT Licence", "MIT"),
        ("Licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
        ("This work is licensed under the GNU General Public License version 2", "GPL-2.0"), ("distributed under the ISC License", "ISC"),
    ]:
        assert [f[0] for f in scanner.scan(f"see here {text} and so on")] == [name], text
    for name, text, *_ in licenses.COMMON:
        assert name in [f[0] for f in scanner.scan(f"{filler(3)} {text} {filler(4)}")]
    assert scanner.scan("Released under the BSD License.") == [] and scanner.scan("a license to thrill") == []
    assert [f[0] for f in SCANNER.scan("under the GNU Lesser General Public License, version 3")] == []
