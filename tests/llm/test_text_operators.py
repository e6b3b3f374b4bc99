"""Personal data, license scans and language identification against plain versions."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parkflow.llm import langid, licenses, pii
from parkflow.llm.queries import vocabulary


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod_97(s):
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


CHECKS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", mod_97),
}


def plain(text):
    found = []
    for rank, (kind, (pattern, ok)) in enumerate(CHECKS.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m.group())]
    return sorted(found)


PII = [
    "write a.b+c@mail.example.com, x@y.z_foo@bar.com or @no a@b a@b.c@d.e é@ü.de ..@-.-",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 1.2.3 12.34.56.78.9 ééé 8.8.8.8",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 41111111111111113 378282246310005 5  5 1 2",
    "call +1 (415) 555-2671 or +49.30.123456 +1 2 +123456789012345678 +1((((((2 +44 20 7946 0958.",
    "iban DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not DE89370400440532013001",
    "1 " * 4000 + "1" * 6000, "1.1." * 3000, "a.b-" * 5000, "+1" + " " * 5000 + "2", "x" * 30000 + "@", "😀 a@b.cd 😀 1.1.1.1",
]


def test_pii(spark, docs_of, odd):
    rows = [*odd, *PII, *PII]
    got = {r.doc_id: r for r in pii.scan_pii(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        spans = plain(t)
        base = [s for s in spans if s[3] in pii.BASE]
        text = lambda ss: ",".join(f"{k}:{a}:{b}" for a, _, b, k in ss)
        assert got[i].spans == text(spans), (t or "")[:80]
        assert got[i].base_sha256 == hashlib.sha256(text(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[3] == k for s in base) for k in pii.BASE]
        assert len(got[i].scores) == len(spans)


def test_pii_scores_and_redaction(spark, docs_of):
    rows = ["my email is a@b.co", "see a@b.co", "at 4111 1111 1111 1111, x", None, "", "none", "+1 415 555 2671.1.1.1 z"]
    found = pii.find_pii(docs_of(rows)).withColumn("clean", pii.redact(F.col("text"), F.col("pii"))).orderBy("doc_id").collect()
    assert found[0].pii[0].score == pytest.approx(1.0) and found[1].pii[0].score == pytest.approx(0.9)
    assert [r.clean for r in found] == ["my email is [EMAIL]", "see [EMAIL]", "at [CARD], x", None, "", "none", "[PHONE] z"]


def test_mod_97_and_luhn(spark):
    df = spark.createDataFrame([("GB82WEST12345698765432", "79927398713"), ("GB82WEST12345698765431", "79927398710")], "a string, b string")
    assert [tuple(r) for r in df.select(pii.mod_97(F.col("a")), pii.luhn(F.col("b"))).collect()] == [(True, True), (False, False)]


def plain_licenses(text, templates):
    """license: (first word, shingles found) of the window that holds most of it, the earliest of several."""
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    own = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    found = {}
    for name, notice in templates.items():
        w = [x for x in re.split(r"[\W_]+", notice.lower()) if x]
        known = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        width = 2
        while width < 2 * len(known):
            width *= 2
        for at in range(0, len(own), width // 2):
            n = len(known & set(own[at : at + width]))
            if n >= 0.8 * len(known) and n > found.get(name, (0, 0))[1]:
                found[name] = at, n
    return found


def test_licenses(spark, docs_of, odd):
    filler = " ".join(f"w{i}" for i in range(300))
    full = [f"{filler} {notice} {filler}" for notice in licenses.TEMPLATES.values()]
    broken = [licenses.TEMPLATES["Apache-2.0 notice"].replace("agreed", "ordered"), licenses.TEMPLATES["MIT grant"][: len(licenses.TEMPLATES["MIT grant"]) // 2], "under the MIT", filler]
    data = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = [*odd, *full, *broken, *full[:2], f"{full[0]} {full[0]} {full[5]}", *data]
    long = {"long": " ".join(f"term{i} of w{i % 7}" for i in range(400)), **licenses.TEMPLATES}
    for templates in (None, long):
        got = licenses.scan_licenses(docs_of([*rows, f"{filler} {long['long'].replace('term9 ', 'other ')} {filler}"]), templates).collect()
        by_doc = {}
        for r in got:
            assert r.containment == r.n_found / r.n_template >= 0.8
            assert r.license not in by_doc.setdefault(r.doc_id, {})
            by_doc[r.doc_id][r.license] = r.first_word, r.n_found
        for i, t in enumerate(rows):
            assert by_doc.get(i, {}) == plain_licenses(t, templates or licenses.TEMPLATES), t
        assert ("long" in by_doc.get(len(rows), {})) == (templates is long)
    assert licenses.scan_licenses(docs_of(["x"]).limit(0)).collect() == []


def plain_forward(word, pieces, table, j):
    word = "▁" + word
    alpha = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            p = pieces.get(word[start:end])
            q = table[p, j] if p is not None else langid.UNKNOWN if end - start == 1 else 0.0
            alpha[end] += alpha[start] * q
    return alpha[-1]


def plain_part(text, pieces, table):
    """As plain_forward, for letters without the mark of a word's start."""
    alpha = [1.0] + [0.0] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 20), end):
            p = pieces.get(text[start:end])
            alpha[end] += alpha[start] * (table[p, 0] if p is not None else langid.UNKNOWN if end - start == 1 else 0.0)
    return alpha[-1]


def test_language(spark, odd):
    path = vocabulary("piece_bpe_32k.model")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = langid.train(docs.limit(200), path)
    lookup = langid.Lookup(langid._pieces(path))
    for words in (["their", "house"], ["é", "a"], ["qx☃z"], ["internationally"], ["übergröße"], ["a𝒳b"]):
        for w, row in zip(words, langid.forward(words, lookup, table)):
            assert all(math.isclose(math.exp(x), plain_forward(w, langid._pieces(path), table, j), rel_tol=1e-6) for j, x in enumerate(row))
    got = {r.doc_id: r for r in langid.identify_languages(docs, path).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(got) == len(truth) and 100 < len(held) < 300
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_results_of_documents(docs_of):
    """lang_pred, score and surprise of whole documents by plain sums, at any amount of what was learned."""
    path = vocabulary("piece_bpe_32k.model")
    pieces = langid._pieces(path)
    base = [("the house and the garden of their friends", "a", "s"), ("das haus und der garten von ihren freunden", "b", "s"), ("la maison et le jardin de leurs amis", "c", "s")]
    asked = ["the friends of the house", "der garten", "Le Jardin, LA maison", "qx zz", "the das", "übung 12 x"]
    for times in (1, 40, 900):
        docs = docs_of([*base * times, *[(t, None, "s") for t in asked]])
        langs, table = langid.train(docs.filter(~langid.held_out()), path)
        got = {r.doc_id: r for r in langid.identify_languages(docs, path).collect()}
        learned = langid.SMOOTHING / table.min(axis=0) - langid.SMOOTHING * len(table)
        for i, t in enumerate(asked, len(base) * times):
            words = langid.words_of(t)
            logs = [sum(math.log(plain_forward(w, pieces, table, j)) for w in words) for j in range(len(langs))]
            best = max(range(len(langs)), key=logs.__getitem__)
            entropy = -sum(x * math.log(x) for x in table[:, best])
            letters = table[:, best].sum() + sum(table[k, best] * (len(p) - 1) for p, k in pieces.items())
            usual = (learned[best] * entropy / letters + langid.PRIOR_PIECES * -math.log(langid.UNKNOWN)) / (learned[best] + langid.PRIOR_PIECES)
            surprise = -logs[best] / sum(len(w) + 1 for w in words) / usual
            r = got[i]
            assert r.lang_pred == langs[best]
            assert math.isclose(r.score, 1 / sum(math.exp(x - logs[best]) for x in logs), rel_tol=1e-6)
            assert math.isclose(r.surprise, surprise, rel_tol=1e-6)


def test_expected_pieces():
    path = vocabulary("piece_bpe_32k.model")
    pieces = langid._pieces(path)
    lookup, prior = langid.Lookup(pieces), langid.rank_prior(pieces)
    table = prior[:-1, None]
    for word in ("house", "qx☃z", "ab" * 12, "x" * 60):
        which, piece, n = langid.expected_pieces([word, word], lookup, prior)
        got = {int(i): k for w, i, k in zip(which, piece, n) if w == 1}
        whole = sum(k for w, k in zip(which, n) if w == 0)
        want, marked = {}, "▁" + word
        total = math.exp(langid.forward([word], lookup, table)[0, 0])
        for i in range(len(marked)):
            for j in range(i + 1, len(marked) + 1):
                if (k := pieces.get(marked[i:j])) is not None:
                    before, after = (plain_part(x, pieces, table) for x in (marked[:i], marked[j:]))
                    want[k] = want.get(k, 0) + before * prior[k] * after / total
        sums = {}
        for w, i, k in zip(which, piece, n):
            if w == 0:
                sums[int(i)] = sums.get(int(i), 0) + k
        assert sums.keys() == want.keys() and all(math.isclose(sums[k], want[k] * 1e6, rel_tol=1e-3, abs_tol=40) for k in want)
        assert got and whole


def test_long_and_unknown_words(docs_of):
    """No word is cut, and none is lost to underflow."""
    path = vocabulary("piece_bpe_32k.model")
    pieces = langid._pieces(path)
    lookup = langid.Lookup(pieces)
    rng = np.random.default_rng(3)
    table = rng.random((max(pieces.values()) + 1, 2)) ** 8
    table /= table.sum(axis=0)
    for word in ("donaudampfschifffahrtsgesellschaftskapitänsmützenabzeichen", "ab" * 200, "ꙮ" * 90, "a" * 15, "a" * 16):
        got = langid.forward([word, word], lookup, table)
        assert np.isfinite(got).all() and (got[0] == got[1]).all()
        if len(word) < 60:
            assert all(math.isclose(got[0, j], math.log(plain_forward(word, pieces, table, j)), rel_tol=1e-9) for j in range(2))
    half = "".join(chr(0x1F00 + i % 3) for i in range(60))
    rows = [("alpha " * 60, "a", "s"), ("omega " * 60, "b", "s")] * 600 + [("alpha" + half, None, "s"), ("omega" + "ꙮ" * 100, None, "s")]
    got = {r.doc_id: r for r in langid.identify_languages(docs_of(rows), path).collect()}
    assert (got[1200].lang_pred, got[1201].lang_pred) == ("a", "b")
    assert got[1201].surprise > 2 > got[0].surprise


def test_language_of_odd_texts(docs_of, odd):
    path = vocabulary("piece_bpe_32k.model")
    rows = [*odd, ("12 34 !", None, None), ("² ½", None, None), ("ça", None, None)]
    got = {r.doc_id: r for r in langid.identify_languages(docs_of(rows), path).collect()}
    for i, t in enumerate(rows):
        t = t[0] if isinstance(t, tuple) else t
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert langid.identify_languages(docs_of(["x"]).limit(0), path).collect() == []
    assert {r.lang_pred for r in langid.identify_languages(docs_of([("text", None, "a")]), path).collect()} == {"und"}
