import random

import pytest

from folioflow.llm import licenses


@pytest.mark.parametrize(("name", "text"), licenses.TEMPLATES)
def test_every_template_is_found(name, text):
    found = licenses.judge(text)
    assert found and found[0] == name and found[2] == 1.0 and found[1] >= licenses.REDUCTION


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the MIT License.", "MIT"),
        ("This file: Licensed under the Apache License, Version 2.0. See below.", "Apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("A driving licence costs money.", None),
        ("The conditions of the warranty are printed on the box.", None),
        ("Licensed under the Apache License, Version 9.9.", None),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
        ("License: GPLv3", "GPL-3.0"),
        ("Licensed under the LGPL v2.1", "LGPL-2.1"),
        ("# SPDX-License-Identifier: EUPL-1.2 (see the file)", "EUPL-1.2"),
        ("SPDX-License-Identifier: GPL-9.9", None),
    ],
)
def test_notices(text, want):
    found = licenses.judge(text)
    assert (found and found[0]) == want


def test_similar_licenses_are_told_apart():
    long = dict((n, t) for n, t in reversed(licenses.TEMPLATES))
    assert licenses.judge(long["BSD-3-Clause"])[0] == "BSD-3-Clause" and licenses.judge(long["BSD-2-Clause"])[0] == "BSD-2-Clause"
    share, missing, extra = licenses.differences("a b x c".split(), "a b c d".split())
    assert share == 0.75 and missing == ["d"] and extra == ["x"]


def test_text_around_a_notice_does_not_hide_it():
    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(400))
    notice, apache = "Released under the MIT License.", dict(reversed(licenses.TEMPLATES))["Apache-2.0"]
    for text in (f"{noise} {notice}", f"{noise} {notice} {noise}", f"The software that we describe in this long paragraph was written by many people over many years and it is {notice[0].lower()}{notice[1:]} Nobody should be surprised to learn that."):
        assert [x[2] for x in licenses.judge_all(text)] == ["MIT"]
    wrapped = "\n".join([f"copyright {noise[i : i + 60]}" for i in range(0, 1500, 60)] + [apache.replace(" You may", "\nYou may"), "the conditions of the warranty"])
    assert [x[:3] for x in licenses.judge_all(wrapped)] == [(25, 27, "Apache-2.0")]


@pytest.mark.parametrize("between", [" ", "\n", "\nfor the code.\n"])
def test_every_license_of_a_block(between):
    names = ["MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense", "Proprietary"]
    last = dict(licenses.TEMPLATES)
    for chosen in (names, names[::-1], ["MIT", "Apache-2.0"], ["MIT", "Proprietary"], ["MIT", "MIT"]):
        parts = ["All rights reserved." if n == "Proprietary" else last[n] for n in chosen]
        assert [x[2] for x in licenses.judge_all(between.join(parts))] == chosen


def test_documents(spark, docs):
    wrapped = licenses.TEMPLATES[0][1].replace("software and ", "software\nand ").replace("following conditions", "following\nconditions")
    rows = [(1, f"prose\n\n{wrapped}\nmore prose"), (2, None), (3, ""), (4, "no such thing"), (5, "x\nReleased under the MIT License.\ny\ny\ny\nAll rights reserved."), (5, "Released under the MIT License."), (None, "Released under the MIT License.")]
    got = sorted(((r.id, r.line_start, r.line_end, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 2, 5, "MIT"), (5, 1, 2, "MIT"), (5, 5, 6, "Proprietary"), (5, 0, 1, "MIT"), (None, 0, 1, "MIT")], key=repr)
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(docs.limit(0)).count() == 0


def plain(block):
    """Licenses of a block by a plain version: of all places where all words of a template stand in a row, the
    longest first, those that no place taken before touches."""
    words = licenses.wording(block)
    fits = []
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        own = licenses.wording(text)
        fits += [(-len(own), i, a, a + len(own), name) for a in range(len(words) - len(own) + 1) if words[a : a + len(own)] == own]
    taken, out = set(), []
    for _, _, a, z, name in sorted(fits):
        if not taken & set(range(a, z)):
            taken |= set(range(a, z))
            out.append((a, name))
    return [name for _, name in sorted(out)]


@pytest.mark.parametrize("seed", range(6))
def test_like_a_plain_version(seed):
    """Notices in whole wording among other words, both ways: nothing is lost and nothing more is found."""
    rng = random.Random(seed)
    noise = ["the garden was large", "rivers and mountains", "a licence costs money", "copyright of the author", "version 7.7 of it", "under the bridge"]
    for _ in range(40):
        block = " . ".join(rng.choice(noise) if rng.random() < 0.5 else rng.choice(licenses.TEMPLATES)[1] for _ in range(rng.randint(1, 6)))
        assert [x[2] for x in licenses.judge_all(block)] == plain(block), block


def test_candidates_are_no_fewer_than_all():
    """The templates that share a telling word are all that can win."""
    rng = random.Random(2)
    for _ in range(300):
        words = licenses.wording(rng.choice(licenses.TEMPLATES)[1])
        counts = licenses.Counter(w for w in words if rng.random() < 0.95)
        found = {i for w in counts.keys() & licenses._by_word().keys() for i in licenses._by_word()[w]}
        assert {i for i in range(len(licenses.TEMPLATES)) if licenses._holds(counts, i)} <= found


def test_query_finds_every_notice(spark, sf_dir):
    """Brute force: the notices that the driver's documents hold as lines of their own."""
    notices = {t: n for n, t in licenses.TEMPLATES if len(t) < 120}
    want = sorted((r.doc_id, i, notices[x]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for i, x in enumerate(r.text.split("\n")) if x in notices)
    got = sorted((r.doc_id, r.line_start, r.license) for r in licenses.op5_licenses(spark, sf_dir).collect())
    assert set(want) <= set(got)
    assert set(got) == set(want)  # and nothing else


def wrapped(text, width):
    import textwrap

    return "\n".join(textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))


@pytest.mark.parametrize("width", [20, 25, 30, 40, 45, 60, 80, 100, 120])
def test_notices_wrapped_at_any_width(width):
    """From whole texts: each template among prose, its lines broken; the lines that are told hold it all."""
    for name, text in licenses.TEMPLATES:
        body = wrapped(text, width)
        whole = f"Some prose about a garden.\nMore of it here.\n{body}\nAnd then the rivers\nand mountains follow."
        found = licenses.licenses_of(whole)
        assert [x[2] for x in found] == [name], (name, width, text[:40])
        assert found[0][:2] == (2, 2 + body.count("\n") + 1)


@pytest.mark.parametrize("seed", range(4))
def test_whole_texts_like_a_plain_version(seed):
    """Texts of prose and notices, wrapped at random: the same licenses as the plain version finds in the words."""
    rng = random.Random(seed)
    prose = ["the garden was large", "rivers and mountains lie far away", "a licence costs money", "copyright of the author", "version 7.7 of it", "under the bridge", "the conditions were good"]
    for _ in range(25):
        parts = [rng.choice(prose) if rng.random() < 0.6 else rng.choice(licenses.TEMPLATES)[1] for _ in range(rng.randint(1, 9))]
        text = wrapped(" . ".join(parts), rng.randint(20, 120))
        assert [x[2] for x in licenses.licenses_of(text)] == plain(text), text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MIT License", ["MIT"]),
        ("This project is MIT licensed.", ["MIT"]),
        ("GPLv3", ["GPL-3.0"]),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", ["GPL-3.0"]),
        ("                                 Apache License\n                           Version 2.0, January 2004", ["Apache-2.0"]),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["MIT", "Apache-2.0"]),
        ("// SPDX-License-Identifier: GPL-2.0-only AND (BSD-3-Clause OR ISC)", ["GPL-2.0", "BSD-3-Clause", "ISC"]),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
        ("SPDX-License-Identifier: MIT OR GPL-9.9", ["MIT"]),
        ("Students of Harvard or MIT need no licence.", []),
    ],
)
def test_short_forms(text, want):
    assert [x[2] for x in licenses.licenses_of(text)] == want


def test_long_blocks_are_not_kept():
    text = "license " + "words of it " * 1000 + "MIT License"
    before = licenses._kept.cache_info().currsize
    assert [x[2] for x in licenses.judge_all(text)] == ["MIT"] and licenses._kept.cache_info().currsize == before


def test_cues_hold_stems():
    for _, text in licenses.TEMPLATES:
        for cue in licenses.CUES.finditer(text):
            assert any(x in cue[0].casefold() for x in licenses.STEMS), cue[0]
    for cue in ("CC-BY", "cc0 by", "All\nRights\tReserved", "SUBLICENSE", "LiCenCe", "licenſe", "AGPL v3", "Merchantable"):
        assert licenses.cued(f"x {cue} y")
    assert not licenses.cued("a garden by the river") and not licenses.cued(None)


def test_compression_ranks_the_templates_that_meet():
    """A changed word costs the longer text a little; the shorter one in it is whole but accounts for less."""
    long = dict((n, t) for n, t in reversed(licenses.TEMPLATES))
    changed = long["BSD-3-Clause"].replace("specific prior written", "explicit prior written")
    found = licenses.judge_all(changed)
    assert [x[2] for x in found] == ["BSD-3-Clause"] and found[0][5:] == (["specific"], ["explicit"])
    apache = long["Apache-2.0"].replace("you may not use", "you must not use")
    found = licenses.judge_all(apache)
    assert [x[2] for x in found] == ["Apache-2.0"] and found[0][5:] == (["may"], ["must"])
