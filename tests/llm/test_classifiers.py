import zlib

import numpy as np
import pytest

from shelfmark.llm import learning, licenses, quality, toxicity
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def auc(scores):
    pos = np.array([s for s, y in scores if y == 1])
    neg = np.array([s for s, y in scores if y == 0])
    return (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()


@pytest.mark.parametrize(("name", "label", "least"), [("op8_toxicity", "toxic", 0.9), ("op9_quality", "quality", 0.95)])
def test_held_out_ranking(spark, name, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert auc([(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]) > least


def test_isotonic_is_monotone_and_pools():
    curve = learning.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 8.0, 2.0, 10.0]), np.full(4, 10.0))
    y = curve(np.linspace(0, 1, 50))
    assert (np.diff(y) >= 0).all() and curve(np.array([0.25]))[0] == pytest.approx(0.5, abs=0.02)
    assert learning.isotonic(np.zeros(0), np.zeros(0), np.zeros(0))(np.array([3.0]))[0] == 0.5


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.5)).astype(float)
    assert ((learning.boosted_trees(x, y)(x) > 0) == (y == 1)).mean() > 0.98
    assert learning.boosted_trees(x[:0], y[:0])(x[:3]).tolist() == [0, 0, 0]


ROWS = [(1, "you are an idiot and a moron"), (2, "a fine day in the garden"), (3, None), (4, ""), (5, "word " * 30_000), (2, "a fine day in the garden"), (None, "you 1d1ot")]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(spark, module):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'own' AS score", "1 AS label")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (None, 1, 0), (1, None, None)], "doc_id long, toxic int, quality int")
    for own in (labels, labels.limit(0)):
        out = module.score(docs, module.train(docs, own)).collect()
        assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id == 2}) == 1
        assert module.score(docs.limit(0), module.train(docs, own)).collect() == []
    untrained = {r.doc_id: r.score for r in module.score(docs, module.train(docs.limit(0), labels)).collect()}
    assert untrained[2] == (0.0 if module is toxicity else 0.5)


def test_toxic_features():
    m = toxicity.ToxicityModel(frozenset(toxicity.INSULTS), frozenset(["vequ"]))
    f = dict(zip(toxicity.FEATURES, m.features(b"You IDIOT, vequila sooo 1d1ot i-d-i-o-t fine")))
    assert f["log_hits"] == pytest.approx(np.log1p(3)) and f["log_beginnings"] == pytest.approx(np.log1p(1))
    assert f["disguised_density"] == pytest.approx(2 / 7) and f["near_second_person"] == 1.0


def test_normal_equations_equal_the_direct_fit(spark):
    texts = [(k, ("fine words here. " * (k % 7 + 1)) if k % 2 else "## !! " * (k % 5 + 1)) for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k, _ in texts], "doc_id long, quality int")
    m = quality.train(docs, labels)
    fold = {r.doc_id: r.f for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 5) AS f").collect()}
    x = np.array([quality.statistics(t.encode()) for k, t in texts if fold[k]])
    y = np.array([k % 2 for k, _ in texts if fold[k]], float)
    z = m.features(x)
    direct = np.linalg.solve(z.T @ z + 1e-3 * len(z) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ direct, m.raw(x), atol=1e-6)


def plain_features(words_in, beginnings, text):
    """The features of a text, word by word."""
    words = text.split()
    hits, heads, persons, disguised, stretched, capitals, distinct, near = [], 0, [], 0, 0, 0, set(), []
    for k, word in enumerate(words):
        low = word.strip(toxicity.EDGES).lower()
        plain = low
        for a, b in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "*": "", "_": "", "-": "", ".": ""}.items():
            plain = plain.replace(a, b)
        inner = any(low[i].isascii() and low[i].isalpha() and low[i + 1] in "0123456789$@!*_.-" and any(c.isascii() and c.isalpha() for c in low[i + 2 :].lstrip("0123456789$@!*_.-")[:1]) for i in range(len(low) - 2))
        is_hit = low in words_in
        if not is_hit and inner and plain in words_in:
            is_hit = True
            disguised += 1
        begins = any(low[:n] in beginnings for n in (4, 5, 6))
        heads += begins
        stretched += any(low[i].isascii() and low[i].isalpha() and low[i] == low[i + 1] == low[i + 2] for i in range(len(low) - 2))
        capitals += len(word) > 2 and word.isupper()
        if is_hit:
            hits.append(k)
        if is_hit or begins:
            distinct.add(low)
            near.append(k)
        if low in toxicity.SECOND_PERSON:
            persons.append(k)
    n, raw = max(len(words), 1), text.encode()
    size = max(len(raw), 1)
    close = np.mean([min(abs(k - p) for p in persons) <= 5 for k in near]) if near and persons else 0.0
    punctuation = sum(chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in raw)
    return [
        len(hits) / n, np.log1p(len(hits)), len(distinct), heads / n, np.log1p(heads), close, len(persons) / n, disguised / n, stretched / n, capitals / n,
        sum(65 <= c <= 90 for c in raw) / size, punctuation / size, raw.count(b"!") / size, sum(48 <= c <= 57 for c in raw) / size, np.log1p(len(words)),
    ]


def test_toxicity_equals_brute_force(spark):
    import random

    rng = random.Random(6)
    toxic, fine = ["idiot", "m0r0n", "STUPID!!", "you", "vequila", "vequolo", "looooser", "i-d-i-o-t", "tr@sh"], ["garden", "fine", "day", "the", "you", "walk", "Été", "ß", "12", "A.B."]
    rows = [(k, " ".join(rng.choice(toxic if k % 3 == 0 and rng.random() < 0.4 else fine) for _ in range(rng.randrange(1, 60)))) for k in range(400)]
    rows += [(1000, "x" * 60 + "yyy " + "id1ot " * 3000), (1001, ""), (1002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)], "doc_id long, toxic int"))
    assert any(x.startswith("vequ") for x in m.words | m.beginnings)
    x = np.array([plain_features(m.words, m.beginnings, t or "") for _, t in rows])
    assert np.allclose(x, [m.features((t or "").encode()) for _, t in rows])
    raw = np.full(len(x), m.trees.base)
    for f, cut, leaf in zip(m.trees.feature, m.trees.threshold, m.trees.leaf):
        for r in range(len(x)):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[r, f[node]] > cut[node])
            raw[r] += leaf[node - len(f)]
    want = dict(zip([k for k, _ in rows], np.interp(raw, m.curve.x, m.curve.y)))
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_copies_in_the_toxic_sample_count_once_whatever_their_order(spark):
    rows = [(k, t) for k, t in enumerate(["Bad  zorgle words", "bad zorgle\nwords", "bad zorgle words and five more words here", "fine words"] * 30)]
    labels = [(k, int(k % 4 < 2 and k % 8 < 4)) for k, _ in rows]
    models = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        models.append(toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    a, b = models
    assert a.words == b.words and (a.trees is None) == (b.trees is None)
    probe = np.array([a.features(b"bad zorgle words"), a.features(b"fine")])
    assert (a.curve(a.trees(probe)) == b.curve(b.trees(probe))).all()


def test_quality_equals_brute_force(spark):
    import collections
    import statistics

    texts = [(k, ("Fine words here. And MORE.\nA line\n" * (k % 7 + 1)) if k % 2 else "## !! 12 |\n" * (k % 5 + 1)) for k in range(150)] + [(900, ""), (901, None), (902, "été ñ" * 5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    m = quality.train(docs, spark.createDataFrame([(k, k % 2) for k in range(150)], "doc_id long, quality int"))

    def plain(t):
        raw = t.encode()
        words, size = raw.split(), max(len(raw), 1)
        n, count = max(len(words), 1), collections.Counter(raw)
        share = lambda cs: sum(count[ord(c)] for c in cs) / size
        lines = [x for x in raw.split(b"\n") if x]
        lengths = [len(w) for w in words] or [0]
        return [
            np.log1p(len(raw)), np.log1p(len(words)), statistics.fmean(lengths), statistics.pstdev(lengths), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"),
            share("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), sum(v for c, v in count.items() if c > 127) / size, share("\n"), share("!"), share("#$%&*"), share("|"), len(set(words)) / n,
            1 - len(set(lines)) / max(len(lines), 1), sum(w[-1:] in (b"#", b"$", b"%", b"&", b"*", b"!", b"|") for w in words) / n, sum(w.isupper() for w in words) / n,
        ]

    got = {r.doc_id: r.score for r in quality.score(docs, m).collect()}
    assert got == {r.doc_id: pytest.approx(r.score) for r in quality.score(quality.measured(docs, out="x"), m, statistics_col="x").collect()}
    for k, t in texts:
        z = [np.sqrt(2 / len(m.phase)) * np.cos(sum((v - a) / s * w for v, a, s, w in zip(plain(t or ""), m.mean, m.scale, f)) + p) for f, p in zip(m.frequency.T, m.phase)]
        assert got[k] == pytest.approx(np.interp(np.dot([*z, 1.0], m.weight), m.curve.x, m.curve.y), abs=1e-6)


def brute_scan(text):
    """Known sentences in a text: at each place, the longest known run of lines without a sentence end between them."""
    import re

    known = [(name, [x for x in map(licenses.normalised, re.split(licenses.SENTENCE_END, form)) if x]) for name, v in licenses.SENTENCES.items() for form in ((v,) if isinstance(v, str) else v)]
    pieces = {x for _, ps in known for x in ps}
    units = []
    for part in re.split(licenses.SENTENCE_END, text or ""):
        lines = [x for x in map(licenses.normalised, part.split("\n")) if x]
        while lines:
            n = max((n for n in range(1, len(lines) + 1) if " ".join(lines[:n]) in pieces), default=1)
            units.append(" ".join(lines[:n]))
            lines = lines[n:]
    out, rest, left = [], [], 0
    for at in range(len(units)):
        fits = [(len(ps), name) for name, ps in known if units[at : at + len(ps)] == ps]
        if fits:
            out += [*brute_notices(rest), max(fits)[1]]
            rest, left = [], max(left, max(fits)[0])
        elif not left:
            rest += units[at].split()
        left = max(0, left - 1)
    return out + brute_notices(rest)


def brute_notices(words):
    """Licences that words say something is given under, word by word."""
    names = {tuple(licenses.normalised(x).split()): name for name, forms in licenses.NAMES.items() for x in (name, *forms)}
    out, k = [], 0
    while k + 1 < len(words):
        at = k + 2
        if words[k] in ("licensed", "licenced", "released", "distributed", "available", "published", "provided", "redistributed") and words[k + 1] == "under":
            if words[at : at + 3] in (["the", "terms", "of"], ["the", "conditions", "of"]):
                at += 3
            elif words[at : at + 2] in (["terms", "of"], ["conditions", "of"]):
                at += 2
            at += words[at : at + 1] in (["the"], ["a"], ["an"])
            fits = max((n for n in range(1, 12) if tuple(words[at : at + n]) in names), default=0)
            if fits:
                out.append("notice-" + names[tuple(words[at : at + fits])])
                k = at + fits - 1
        k += 1
    return out


def first_form(name):
    v = licenses.SENTENCES[name]
    return v if isinstance(v, str) else v[0]


#: A licence's header as files have it.
APACHE_HEADER = """# Copyright 2020 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""


def test_license_scan_equals_brute_force(spark):
    import textwrap

    full = ".\n".join(first_form(k) for k in ("apache-2.0-notice", "apache-2.0-comply", "apache-2.0-obtain", "apache-2.0-basis"))
    mit = first_form("mit-grant") + ":\n" + first_form("mit-include") + ".\n" + first_form("mit-as-is") + "."
    gpl = first_form("gpl-3.0-or-later") + ". " + first_form("gpl-hope") + "."
    isc = first_form("isc-grant") + ".\n\n" + first_form("isc-as-is") + "."
    bsd = ".\n".join(first_form(k) for k in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")) + "."
    wrap = lambda t, n: "\n".join(textwrap.fill(x, n) for x in t.split("\n"))
    texts = [full, mit, gpl, "Some prose. RELEASED under the  MIT license!\nMore.", first_form("mit-notice") + ". " + first_form("mit-notice") + ".", "No licence at all.", "", None, mit + "\n" + full]
    texts += [first_form("bsd-redistribution") + ". " + first_form("bsd-source"), "Licensed under the MIT", APACHE_HEADER, wrap(mit, 70), wrap(gpl, 60), "A heading\n" + wrap(isc, 40), wrap(bsd, 72)]
    texts += ["prose before\nLicensed under CC BY-SA 4.0\nprose after", "// SPDX-License-Identifier: MIT\nint main;", "word " * 200_000 + "\nReleased under CC0 1.0", "line\n" * 30_000 + "license\n" * 3000]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "'x' AS licenses", "1 AS _row", "'c' AS candidate")
    got = sorted((r.doc_id, r.sentences, r.licenses, r.matches) for r in licenses.scan(docs).collect())
    want = []
    for k, t in enumerate(texts):
        names = brute_scan(t) if len(t or "") < 100_000 else ["cc0-notice"] if "CC0" in t else []
        m = licenses.match(names, licenses.RULES)
        want.append((k // 2, ",".join(names), ",".join(sorted({x[0] for x in m})), len(m)))
    assert got == sorted(want)
    by_text = {k: ",".join(sorted({x[0] for x in licenses.match(licenses.Known(licenses.SENTENCES).found(t or ""), licenses.RULES)})) for k, t in enumerate(texts[:18])}
    assert [by_text[k] for k in (0, 1, 2, 3, 11, 12, 13, 14, 15, 16, 17)] == ["Apache-2.0", "MIT", "GPL-3.0-or-later", "MIT", "Apache-2.0", "MIT", "GPL-3.0-or-later", "ISC", "BSD-3-Clause", "CC-BY-SA-4.0", "MIT"]
    assert licenses.scan(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This project is licensed under the MIT License.", "MIT"), ("Licensed under the MIT license, see LICENSE", "MIT"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"),
        ("// spdx-license-identifier: GPL-2.0", "GPL-2.0-only"), ("# SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL-3.0-or-later"), ("/* SPDX-License-Identifier: ((GPL-2.0+ WITH Linux-syscall-note) OR BSD-3-Clause) */", "BSD-3-Clause,GPL-2.0-or-later"),
        ("SPDX-License-Identifier: MIT AND (", ""), ("SPDX-License-Identifier: Unheard-Of", ""), ("SPDX-License-Identifier: LicenseRef-own AND ISC", "ISC,LicenseRef-own"), ("SPDX-License-Identifier:", ""),
        ("It is distributed under the terms of the GNU General Public License v3.0 or later", "GPL-3.0-or-later"), ("Copyright A\nis available under an\nEclipse Public License 2.0", "EPL-2.0"),
        ("Released under CC BY-NC-SA 4.0 and so on", "CC-BY-NC-SA-4.0"), ("we walked under the MIT dome; nothing was licensed under it", ""), ("Published under CDDL 1.0. Or licensed under the Artistic License 2.0!", "Artistic-2.0,CDDL-1.0"),
    ],
)
def test_notices_and_expressions(spark, text, want):
    (row,) = licenses.scan(spark.createDataFrame([(1, f"Some prose before. Then:\n\n{text}\n\nAnd after.")], "doc_id long, text string")).collect()
    assert row.licenses == want and row.matches == len([x for x in want.split(",") if x])


def test_every_name_of_a_licence_is_known():
    known = licenses.Known(licenses.SENTENCES)
    for name, forms in licenses.NAMES.items():
        assert licenses.identifiers(name) == [name]
        for form in (name, *forms):
            text = f"All of it is released under the {form} as of today"
            assert {x[0] for x in licenses.match(known.found(text), licenses.RULES)} == {name}
            assert brute_notices(licenses.normalised(text).split()) == [f"notice-{name}"]


def test_every_known_sentence_has_one_of_the_words():
    table = licenses.Known(licenses.SENTENCES)
    words = table.words()
    assert len(words) < 12
    for known in licenses.SENTENCES.values():
        for form in (known,) if isinstance(known, str) else known:
            assert any(w in form.lower() for w in words)
