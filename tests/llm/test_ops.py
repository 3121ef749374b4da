"""The training-data operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, common, embed_dedup, html_extract, html_pages, lang_crf, license_scan, mixing, packing, simhash, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)


def clashing(df):
    """df with columns whose names the operators use inside."""
    for name in ("id", "row", "n", "fp", "part", "size", "label", "digest", "score", "rank", "component_id", "v", "c"):
        df = df if name in df.columns else df.withColumn(name, F.lit("x"))
    return df


# --- connected components ---------------------------------------------------------------------


def test_components_of_paths_stars_and_cliques(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(a, b) for a in range(200, 208) for b in range(200, 208)] + [(5, 5), (None, 3)]
    found = dict(common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, **{i: 200 for i in range(200, 208)}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 10, 1 << 26])
def test_rows_without_keys_are_found_by_a_sketch_of_any_size(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "SKETCH_BITS", bits)
    rows = spark.createDataFrame([(i if i else None, f"x{i}", "y") for i in range(300)] + [(7, "again", "y")], "n long, word_ string, likely_ string")
    keys = spark.range(0, 300, 7).withColumnRenamed("id", "k")
    found = common.anti(rows, "n", keys)
    assert found.columns == rows.columns
    assert sorted(r["word_"] for r in found.collect()) == sorted(f"x{i}" for i in range(300) if i % 7 or not i)
    assert common.anti(rows, "n", keys.limit(0)).count() == 301


# --- 1: licences ------------------------------------------------------------------------------


def test_licenses_are_found_whatever_their_case_marks_and_spelling(spark):
    mit = dict(license_scan.LICENSES[:1])["MIT"]
    loud = "Copyright (c) 2020 Someone Else\n\n" + mit.upper().replace("SUBLICENSE", "sublicense").replace(",", " ,") + "\n\nAll rights reserved."
    rows = [(1, loud, "en", "a"), (2, mit + "\nand more", "en", "a"), (3, None, None, None), (4, "", "en", "a"), (5, "text\nReleased under the MIT Licence\nLicensed under CC BY-NC 4.0.", "en", "a"), (5, "x", "en", "a"), (None, mit, "en", "a")]
    found = {(r["id"], r["license_id"], r["notices"]) for r in license_scan.scan(clashing(docs(spark, rows))).collect()}
    assert found == {(1, "MIT", ""), (2, None, ""), (3, None, ""), (4, None, ""), (5, None, "CC-BY-NC-4.0,MIT"), (5, None, ""), (None, "MIT", "")}
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_every_known_text_is_its_own_licence(spark):
    rows = [(i, t, None, None) for i, (_, t) in enumerate(license_scan.LICENSES)]
    found = {r["id"]: r["license_id"] for r in license_scan.scan(docs(spark, rows)).collect()}
    assert found == {i: name for i, (name, _) in enumerate(license_scan.LICENSES)}


def test_files_with_titles_other_marks_and_owners(spark):
    by = {}
    for name, text in license_scan.LICENSES:
        by.setdefault(name, text)
    rows = [
        (1, "BSD 3-Clause License\n\nCopyright (c) 2019, Someone\nAll rights reserved.\n\n" + by["BSD-3-Clause"], "BSD-3-Clause"),
        (2, "ISC License\n\nCopyright (c) 2004 by Someone\n\n" + by["ISC"], "ISC"),
        (3, "Copyright 2001 X\n\n" + by["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* "), "BSD-2-Clause"),
        (4, by["BSD-3-Clause"].replace("COPYRIGHT HOLDER", "COPYRIGHT OWNER").replace("copyright holder", "copyright owner"), "BSD-3-Clause"),
        (5, by["Apache-2.0"].replace("http:", "https:"), "Apache-2.0"),
        (6, "Some other title\n\n" + by["ISC"], None),
    ]
    found = {r["id"]: r["license_id"] for r in license_scan.scan(docs(spark, [(i, t, None, None) for i, t, _ in rows])).collect()}
    assert found == {i: want for i, _, want in rows}


def test_every_known_text_is_found_as_a_line(spark):
    rows = [(i, "before\n" + " ".join(t.split()) + "\nafter", None, None) for i, (_, t) in enumerate(license_scan.LICENSES)]
    found = {r["id"]: r["notices"] for r in license_scan.scan(docs(spark, rows)).collect()}
    assert found == {i: name for i, (name, _) in enumerate(license_scan.LICENSES)}


def test_whole_licence_files_are_known_by_their_digests(spark):
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    files = {n: i for n, i in [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")] if (folder / n).exists()}
    if not files:
        pytest.skip("no licence files on this machine")
    texts = [(folder / n).read_text(encoding="utf-8") for n in files]
    rows = [(i, t.upper().replace(",", " ,"), None, None) for i, t in enumerate(texts)] + [(100 + i, t + "\nand more", None, None) for i, t in enumerate(texts)]
    found = {r["id"]: r["license_id"] for r in license_scan.scan(docs(spark, rows)).collect()}
    assert found == dict(enumerate(files.values())) | {100 + i: None for i in range(len(files))}


def test_very_long_texts_and_equal_digests(spark):
    mit = dict(license_scan.LICENSES[:1])["MIT"]
    long = "word " * 400_000
    known = (("B", "same text"), ("A", "Same, text!"), ("C", "word " * 400_000))
    rows = [(1, long, None, None), (2, "same text", None, None), (3, long + "\nSAME TEXT\n" + mit, None, None)]
    found = {r["id"]: (r["license_id"], r["notices"]) for r in license_scan.scan(docs(spark, rows), licenses=known).collect()}
    assert found == {1: ("C", "C"), 2: ("A", "A"), 3: (None, "A,C")}


# --- 2: SimHash -------------------------------------------------------------------------------


def slow_fingerprint(text, n=4):
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_agree_with_a_slow_form_and_spark(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("AbÉß \n\t\xa0.") for _ in range(rng.randint(0, 80))) for _ in range(200)] + [None, "", "one", "a b c d"]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % 2**64 == slow_fingerprint("a b c d")
    long = "word " * 100_000 + "end"
    assert simhash.fingerprint(long) == slow_fingerprint(long)


def brute_components(values, radius):
    root = list(range(len(values)))
    for i, x in enumerate(values):
        near = np.flatnonzero(np.bitwise_count(np.array(values, np.uint64) ^ np.uint64(x)) <= radius)
        low = min(root[j] for j in near)
        old = {root[j] for j in near}
        root = [low if r in old else r for r in root]
    return root


def test_balls_meet_exactly_where_fingerprints_are_near(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    values = list(base)
    for b in base:
        for k in range(1, 8):
            mask = 0
            for bit in rng.choice(64, k, replace=False):
                mask |= 1 << int(bit)
            values.append(b ^ np.uint64(mask))
    values = np.unique(np.array(values, np.uint64))
    want = brute_components(values, 4)
    for bits in (1, 3, 6):
        a, b = zip(*(simhash.meet(values, part, bits, 4) for part in range(1 << bits)), strict=True)
        found = simhash.forest(len(values), np.concatenate(a), np.concatenate(b))
        assert [want.index(w) for w in want] == [found.tolist().index(f) for f in found.tolist()]
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    linked = dict(common.connected_components(simhash.links(frame)).collect())
    groups = lambda keys: sorted(sorted(np.flatnonzero(np.array(keys) == k).tolist()) for k in set(keys))
    assert groups([linked.get(int(v), int(v)) for v in values.view(np.int64)]) == groups(want)


def test_small_rounds_find_the_same(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(5))
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    values = np.unique(np.concatenate((base, base ^ np.uint64(3), base ^ np.uint64(0b1011 << 20))))
    both = lambda: simhash.forest(len(values), *map(np.concatenate, zip(*(simhash.meet(values, part, 1, 4) for part in (0, 1)), strict=True)))
    whole = both()
    monkeypatch.setattr(simhash, "ROUND_VARIANTS", 1 << 12)
    assert np.array_equal(whole, both()) and len(set(whole.tolist())) == 30


def test_signatures_count_bits_as_a_slow_form_does():
    rng = random.Random(1)
    sets = [simhash.shingle_set(" ".join(str(rng.randint(0, 50)) for _ in range(n)), 5) for n in (0, 1, 4, 5, 6, 10, 300, 1500, 40)]
    found = simhash.signatures(sets, 5, 33)
    salts = simhash.mixed(np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for own, mine in zip(sets, found, strict=True):
        ones = np.unpackbits(simhash.mixed(own[:, None] ^ salts).view(np.uint8), axis=1, bitorder="little").sum(axis=0) * 2 > len(own)
        assert mine.tolist() == [sum(1 << i for i in range(33) if row[i]) for row in ones[:165].reshape(5, 33)]
    assert simhash.signatures([], 3, 32).shape == (0, 3)


def test_linked_sets_agree_with_python_sets():
    rng = random.Random(3)
    sets = [np.unique(np.array(rng.choices(range(60), k=rng.randint(1, 30)), np.int64)) for _ in range(80)]
    sets += [sets[0], sets[1]]
    every = np.arange(len(sets))
    for left, right in ((every, every), (every[:30], every[30:])):
        a, b = simhash.linked_sets(sets, left, right, 0.3)
        want = {(i, j) for i in left for j in right if i != j and len(np.intersect1d(sets[i], sets[j])) >= 0.3 * len(np.union1d(sets[i], sets[j]))}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(want) > 2


def test_a_large_family_of_copies_is_compared_block_by_block(spark):
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    texts = []
    for _ in range(150):
        own = list(base)
        for i in rng.sample(range(150), rng.choice([1, 2, 4, 5, 6])):
            own[i] = f"x{rng.randint(0, 3)}"
        texts.append(" ".join(own))
    found = simhash.similar_documents(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), texts=16).collect()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        near = [j for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)]
        low, old = min(root[j] for j in near), {root[j] for j in near}
        root = [low if r in old else r for r in root]
    assert [r["component_id"] for r in sorted(found, key=lambda r: r["id"])] == root and 1 < len(set(root)) < 150


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(7, long, "en", "a"), (3, long + " tail", "en", "a"), (9, None, None, None), (8, "", "en", "a"), (5, "other text is here", "en", "a"), (5, "other text is here", "en", "a"), (None, long, "en", "a"), (None, "alone with a null id", "en", "a")]
    found = simhash.near_duplicates(clashing(docs(spark, rows))).collect()
    assert sorted((r["id"], r["component_id"]) for r in found if r["id"] is not None) == [(3, 3), (5, 5), (5, 5), (7, 3), (8, 8), (9, 8)]
    assert sum(r["kept"] for r in found) == 4 and {r["component_id"] for r in found if r["id"] is None} == {3, None}
    assert {r["fingerprint"] for r in found if r["id"] in (8, 9)} == {"0" * 16}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_similar_documents_agree_with_brute_force(spark):
    rng = random.Random(12)
    made = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    rows, at = [], 0
    for _ in range(25):
        base = made(rng.choice([40, 200, 600]))
        for rate in (0.0, 0.005, 0.01, 0.03, 0.1):
            rows.append((at, " ".join(rng.choice(made(1)) if rng.random() < rate else w for w in base), "en", "a"))
            at += 1
    rows += [(at, None, None, None), (at + 1, " ", "en", "a"), (at + 2, "one", "en", "a"), (None, rows[0][1].upper(), "en", "a"), (0, rows[0][1], "en", "a"), (at + 3, "x y " * 30_000, "en", "a")]
    found = simhash.similar_documents(clashing(docs(spark, rows))).collect()
    sets = [{tuple((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for _, t, _, _ in rows]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        near = [j for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)]
        low, old = min(root[j] for j in near), {root[j] for j in near}
        root = [low if r in old else r for r in root]
    want = {}
    for (i, _, _, _), r in zip(rows, root, strict=True):
        if i is not None:
            want[i] = min([rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None])
    assert {r["id"]: r["component_id"] for r in found if r["id"] is not None} == want
    assert sum(r["kept"] for r in found) == len(set(root)) and len(found) == len(rows)
    assert simhash.similar_documents(docs(spark, [])).count() == 0


def test_a_repeated_line_neither_links_nor_parts_documents(spark):
    rng = random.Random(5)
    made = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    line, other = "all words on one line " * 60, "seen in another place " * 60
    same = " ".join(made(600))
    texts = [line + " ".join(made(100)), line + " ".join(made(100)), f"{same} {line}", f"{same} {other}"]
    found = simhash.similar_documents(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    assert {r["id"]: r["component_id"] for r in found} == {0: 0, 1: 1, 2: 2, 3: 2}


def test_a_failed_pair_with_the_first_text_does_not_hide_the_pairs_behind_it(spark):
    rng, texts = random.Random(8), []
    made = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    for _ in range(80):
        # 100 shingles each: x and y share 92, the first shares 85 with either.
        start, middle = made(89), made(7)
        texts += [f"{start} {made(15)}", f"{start} {middle} {made(8)}", f"{start} {middle} {made(8)}"]
    for options in ({}, {"texts": 2}):
        found = simhash.similar_documents(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), **options).collect()
        assert {r["id"]: r["component_id"] for r in found} == {i: i - (i % 3 == 2) for i in range(len(texts))}


def test_no_pair_at_the_least_similarity_is_lost(spark):
    rng, texts = random.Random(9), []
    made = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    for n, shared in [(90, 80), (91, 82), (90, 79)] * 100:
        # Similarities of exactly 0.8 and 0.82, and one of 0.78 that is no link.
        same = made(shared + 4)
        texts += [f"{same} {made(n - shared)}", f"{same} {made(n - shared)}"]
    found = simhash.similar_documents(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    assert {r["id"]: r["component_id"] for r in found} == {i: i - (i % 2 and i // 2 % 3 < 2) for i in range(len(texts))}


# --- 3: language ------------------------------------------------------------------------------


def test_forward_backward_agrees_with_all_paths():
    import itertools

    rng = np.random.Generator(np.random.PCG64(1))
    scores, start, moves = rng.normal(size=(4, 2, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    marginals, pair, logs = lang_crf.forward_backward(scores, start, moves)
    expected = np.zeros((3, 3))
    for row in range(2):
        weight = {p: np.exp(start[p[0]] + sum(scores[i, row, p[i]] for i in range(4)) + sum(moves[p[i], p[i + 1]] for i in range(3))) for p in itertools.product(range(3), repeat=4)}
        total = sum(weight.values())
        assert np.isclose(np.log(total), logs[row])
        for i in range(4):
            for k in range(3):
                assert np.isclose(marginals[i, row, k], sum(w for p, w in weight.items() if p[i] == k) / total)
        for p, w in weight.items():
            for i in range(3):
                expected[p[i], p[i + 1]] += w / total
    assert np.allclose(pair, expected)
    padded, _, part = lang_crf.forward_backward(scores, start, moves, np.array([4, 2]))
    short, _, alone = lang_crf.forward_backward(scores[:2, 1:], start, moves)
    assert np.allclose(padded[:2, 1], short[:, 0]) and np.allclose(part[1], alone[0]) and not padded[2:, 1].any()


def test_languages_of_held_out_rows_and_odd_ones(spark):
    from conftest import SF

    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs(spark, [(None, "und der die das", "de", "a"), (100001, None, "en", "a"), (100002, "123 !!", "en", "a"), (100003, "", None, None), (1, "thing the and", "en", "a")])
    model = lang_crf.train(table)
    found = lang_crf.identify(clashing(table.unionByName(odd)), model, keep=("lang",)).collect()
    right = [r["lang_pred"] == r["keep_0"] for r in found if r["id"] is not None and r["id"] < 100000]
    assert len(found) == 205 and np.mean(right) > 0.98
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in found if r["id"] is not None and r["id"] > 100000)
    assert all(0 <= r["score"] <= 1 for r in found)
    held = lang_crf.label_languages(table).where("held_out").count()
    assert held == sum(zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in table.select("doc_id").collect())
    assert lang_crf.label_languages(docs(spark, [])).count() == 0
    assert lang_crf.label_languages(docs(spark, [(1, "a b", None, None)])).first()["lang_pred"] == "und"


def test_words_of_code_switched_text_get_their_own_language(spark):
    from conftest import SF

    rows = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 600").select("lang", "text").collect()
    model = lang_crf.fit([(r["lang"], [lang_crf.words_of(r["text"])[i : i + lang_crf.WINDOW] for i in (0, 24, 48)]) for r in rows])
    of = {r["lang"]: lang_crf.words_of(r["text"])[60:80] for r in rows if len(lang_crf.words_of(r["text"])) > 80}
    a, b = sorted(of)[:2]
    mixed = of[a] + of[b]
    marginals, _, _ = lang_crf.forward_backward(lang_crf.emissions(model, mixed)[:, None], model.start, model.moves)
    said = [model.langs[i] for i in marginals[:, 0].argmax(axis=1)]
    assert np.mean([x == y for x, y in zip(said, [a] * 20 + [b] * 20, strict=True)]) > 0.85


def test_expected_moves_of_a_padded_batch_are_those_of_its_rows():
    rng = np.random.Generator(np.random.PCG64(2))
    scores, start, moves, lengths = rng.normal(size=(5, 3, 3)), rng.normal(size=3), rng.normal(size=(3, 3)), np.array([5, 2, 1])
    _, pair, _ = lang_crf.forward_backward(scores, start, moves, lengths)
    assert np.allclose(pair, sum(lang_crf.forward_backward(scores[:n, [j]], start, moves)[1] for j, n in enumerate(lengths)))


@pytest.mark.parametrize("longer", [1, 10])
def test_languages_of_texts_shorter_than_a_window(spark, longer):
    rng = random.Random(4)
    own = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(60)] for lang, letters in zip("abcde", ("abcdef", "ghijkl", "mnopqr", "stuvwx", "yzäöüß"), strict=True)}
    # Language e has short texts only, among many that have no words at all.
    rows = [(i * 5 + j, " ".join(rng.choice(own[lang]) for _ in range(rng.randint(1, 8) * (1 if lang == "e" else longer))), lang, "s") for i in range(40) for j, lang in enumerate(own)]
    rows += [(1000 + i, rng.choice([None, "", "12 !"]), "e", "s") for i in range(200)]
    found = lang_crf.label_languages(docs(spark, rows), rows=20).where("id < 1000").collect()
    want = {i: lang for i, _, lang, _ in rows}
    assert np.mean([r["lang_pred"] == want[r["id"]] for r in found]) > 0.97 and np.mean([r["score"] for r in found]) > 0.8


def test_numbers_are_no_letters_and_long_texts_are_read_whole(spark):
    assert lang_crf.words_of("½ ² ① Ⅷ x² naïve日本 a_b 4th") == ["x", "naïve日本", "a", "b", "th"]
    own = {"de": "und der die das ein nicht", "en": "and the with that not from"}
    rows = [(i, own[lang], lang, "s") for i, lang in enumerate(["de", "en"] * 30)] + [(100, "½ ² ①", None, "s"), (101, "and " * 10 + "und " * 200_000, None, "s"), (102, "x" * 300_000, "en", "s"), (102, "x" * 300_000, "en", "s")]
    found = {r["id"]: (r["lang_pred"], r["score"]) for r in lang_crf.label_languages(docs(spark, rows)).collect()}
    assert found[100] == ("und", 0.0) and found[101][0] == "de" and found[101][1] > 0.99
    assert all(found[i][0] == lang for i, _, lang, _ in rows[:60])


def test_every_language_is_learned_and_copies_of_a_row_count_once(spark):
    rng = random.Random(2)
    letters = [chr(0x4E00 + 7 * i) for i in range(70)]
    rows = [(i, " ".join(letters[i % 70] + rng.choice(letters[i % 70] + "ab") for _ in range(6)), f"l{i % 70:02}", "s") for i in range(70 * 6)]
    rows += [(9999, rows[0][1], "l01", "s")] * 300
    found = lang_crf.label_languages(docs(spark, rows), rows=4).where("id < 9999").collect()
    assert len({r["lang_pred"] for r in found}) == 70
    assert np.mean([r["lang_pred"] == f"l{r['id'] % 70:02}" for r in found]) > 0.9
    got = lang_crf.sample(docs(spark, rows), F.lit(True), "doc_id", "text", "lang", 4)
    assert len(got) == 280 and max(sum(lang == f"l{i:02}" for lang, _ in got) for i in range(70)) == 4


# --- 4: packing -------------------------------------------------------------------------------


def test_pieces_are_powers_of_two_that_add_up():
    sizes = np.array([1, 2, 3, 7, 2047, 2048, 2049, 10_000])
    row, start, length = packing.pieces(sizes)
    for i, n in enumerate(sizes.tolist()):
        found = length[row == i].tolist()
        assert sum(found) == n and all(x & (x - 1) == 0 and x <= 2048 for x in found) and found == sorted(found, reverse=True)
        assert start[row == i].tolist() == [sum(found[:k]) for k in range(len(found))]
    assert [x.tolist() for x in packing.pieces(np.array([1, 0]), 1)] == [[0], [0], [1]]


def test_ids_are_the_tokenizers_own(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ["".join(rng.choice("abTzé'sß.,!? \n\xa0\x1c9²日Σ|<") for _ in range(rng.randint(0, 50))) for _ in range(400)] + ["<|endoftext|> a", "It's we'll I'D", "İ ΣΑΣ ﬁ"]
    plain = Tokenizer.from_file(packing.vocabulary())
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert packing.Encoder(packing.vocabulary())(texts) == want
    monkeypatch.setattr(packing, "WORDS", 10)
    small = packing.Encoder(packing.vocabulary())
    assert small(texts) == want and small(texts) == want


def test_tokenizers_of_another_kind_read_texts_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(6)
    texts = ["".join(rng.choice("abTzé'sß.,!? \n\xa0\x1c9²日Σ|<") for _ in range(rng.randint(0, 50))) for _ in range(300)]
    plain = Tokenizer.from_file(path)
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.Encoder(path)(texts) == want
    assert packing.splits_words(packing.vocabulary()) and not packing.splits_words(path)


def test_every_id_lies_in_one_piece(spark, monkeypatch):
    long = "thing and more " * 3000
    rows = [(1, long, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "same", "en", "a"), (4, "same", "en", "a"), (None, "no id", "en", "a")]
    found = packing.pack(clashing(docs(spark, rows))).collect()
    encoder = packing.Encoder(packing.vocabulary())
    ids = [np.append(np.frombuffer(encoder([long])[0], "<u4"), 1)]
    mine = sorted((r for r in found if r["id"] == 1), key=lambda r: r["start"])
    assert [x for r in mine for x in r["ids"]] == ids[0].tolist() and all(r["doc_tokens"] == len(ids[0]) for r in mine)
    assert [r["ids"] for r in found if r["id"] in (2, 3)] == [[1], [1]]
    assert sum(r["length"] for r in found if r["id"] == 4) == 2 * (len(encoder(["same"])[0]) // 4 + 1)
    assert sorted(r["sequence_id"] for r in found) == list(range(len(found))) and {r["offset"] for r in found} == {0}
    by = sorted(found, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by] == sorted((r["length"] for r in found), reverse=True)
    for r in found:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    without = packing.pack(docs(spark, rows), ids=False)
    assert without.columns == [c for c in packing.pack(docs(spark, rows)).columns if c != "ids"]
    key = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    joined = packing.pack(docs(spark, rows), ids=False)
    assert sorted(map(str, without.select(key).collect())) == sorted(map(str, joined.select(key).collect()))
    assert packing.pack(docs(spark, [])).count() == 0


# --- 5: mixing --------------------------------------------------------------------------------


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    capped, want = {}, share * sum(sizes.values())
    while True:
        rest = [n for n in names if n not in capped]
        level = (want - sum(capped.values())) / sum(w[n] for n in rest) if rest else 0
        over = [n for n in rest if w[n] * level >= most * sizes[n]]
        if not over:
            return capped | {n: w[n] * level for n in rest}
        capped |= {n: most * sizes[n] for n in over}


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 200]))), "en", rng.choice(["a", "b", "é", "Z", None, "hot", "hot", "hot"])) for i in range(900)]
    rows += [(None, "w w w", "en", "a"), (900, "same size", "en", "b"), (900, "same size", "en", "b"), (901, None, "en", "only null")]
    frame = clashing(docs(spark, rows))
    found = mixing.mix(frame).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    for s in sizes:
        mine = [r for r in found if r["source"] == s]
        assert abs(mine[0]["target"] - want[s]) < 1e-6 and mine[0]["source_size"] == sizes[s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - want[s]) <= 0.02 * sizes[s] + 1
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert all(r["copies"] in (int(rate + 1e-9), int(np.ceil(rate - 1e-9))) for r in mine if r["size"])
        docs_, copies = sum(1 for r in mine if r["size"]), sum(r["copies"] for r in mine)
        assert abs(copies - rate * docs_) <= 3
    again = mixing.mix(frame).collect()
    assert sorted((r["row"], r["copies"]) for r in found) == sorted((r["row"], r["copies"]) for r in again)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mix_of_a_very_long_text_and_equal_sizes(spark):
    rows = [(0, "w " * 1_000_000, "en", "a"), *((i, "w w", "en", "a") for i in range(1, 50)), (50, "w", "en", "b")]
    found = {r["id"]: r for r in mixing.mix(docs(spark, rows)).collect()}
    assert found[0]["size"] == 1_000_000 and found[0]["source_size"] == 1_000_098 and len(found) == 51
    taken = sum(r["copies"] * r["size"] for r in found.values())
    assert found[0]["copies"] in (1, 2) and abs(taken - 1.5 * 1_000_099) <= 500_001


def test_the_flight_keeps_both_sums_and_leaves_two_open():
    rng = np.random.Generator(np.random.PCG64(8))
    sizes, p = rng.integers(1, 500, 400).astype(float), rng.random(400)
    out = mixing.flight(p, sizes, 1)
    assert np.isclose(out.sum(), p.sum()) and np.isclose(out @ sizes, p @ sizes) and ((out > 0) & (out < 1)).sum() <= 2
    mean = np.mean([mixing.flight(np.full(20, 0.3), sizes[:20], s) for s in range(600)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.08
    same = mixing.flight(np.full(50, 0.5), np.full(50, 7.0), 2)
    assert np.isclose(same.sum(), 25)


def test_leftovers_of_many_blocks_meet_again(spark):
    rng = random.Random(9)
    rows = [(str(i), "s", rng.randint(1, 90), 0.4) for i in range(700)]
    found = {r["row"]: r["chosen"] for r in mixing.balanced(spark.createDataFrame(rows, "row string, stratum string, size long, p double"), block=16).collect()}
    assert len(found) == 700
    assert abs(sum(s for i, _, s, _ in rows if found[i]) - 0.4 * sum(r[2] for r in rows)) <= 45
    assert abs(sum(found.values()) - 280) <= 2


# --- 6: WARC ----------------------------------------------------------------------------------


def test_archives_give_back_what_was_written(spark, tmp_path):
    big = "é<p>\r\n" * 400_000
    same = "x" * 150
    rows = [(5, "http://a/%20?q=1", same), (2, "http://b\r\nX: y", same), (9, None, same), (1, "u", "short"), (3, "u", "short"), (4, "v", None), (6, "w", big), (None, "n", same), (7, "WARC/1.1\r\n", "WARC/1.1\r\n\r\n\r\n"), (8, "e", ""), (2, "http://b", same)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    manifest = warc.archive(pages, f"file://{tmp_path}/w")
    found = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.contents(manifest).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = {(i, size(t), sha(t), "revisit" if t == same else "response", 2 if t == same else None) for i, _, t in rows if (i, t) != (2, same)}
    want |= {(2, 150, sha(same), "response", None), (2, 150, sha(same), "revisit", 2)}
    assert found == want and warc.contents(manifest).count() == len(rows)
    chunks = warc.read_warc(manifest, 1 << 16).where(F.col("record_id").startswith("urn:page:6:")).orderBy("chunk_no").collect()
    assert len(chunks) > 30 and b"".join(r["data"] for r in chunks).decode() == big
    crc = 0
    for r in chunks:
        crc = zlib.crc32(r["data"], crc)
        assert r["crc32"] == crc
    urls = {r["target_uri"] for r in warc.read_warc(manifest).collect()}
    assert {"http://a/%20?q=1", "http://b\r\nX: y", None} <= urls
    assert warc.contents(warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")).count() == 0


def test_a_damaged_archive_is_noticed():
    import io

    row = {"record_id": "urn:page:1:0", "record_type": "response", "target_uri": "u", "refers_to": None, "size": 3, "digest": hashlib.sha256(b"abc").hexdigest()}
    good = warc.header(row, "1970-01-01T00:00:00Z") + b"abc\r\n\r\n"
    assert [r[6] for r in warc.parse(io.BytesIO(good))] == [b"abc"]
    for bad in (good.replace(b"abc\r", b"abd\r"), good[:-6], b"x" + good):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))


# --- 7 and 8: vectors -------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def test_top_k_agrees_with_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    x = rng.integers(-3, 4, (300, 8)) / 4
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1100, [float("nan")] * 8, 0), (1200, [float("inf")] + [0.0] * 7, 0), (1300, [None] + [0.0] * 7, 0), (7, x[7].tolist(), 0), (1400, [1.0], 0)]
    frame = clashing(spark.createDataFrame(rows, VECTORS))
    found = topk.top_k(frame, "vec_id", "embedding", F.col("vec_id") % 100 == 0, queries=2, candidates=64, bins=16).collect()
    good = [(i, np.pad(np.floor(1024 * np.array(v, float)), (0, 8 - len(v)))) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found) == sorted(want)


def test_histograms_cut_what_blocks_keep(spark, monkeypatch):
    rng = np.random.default_rng(70)
    frame = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    kept = {}

    def table(df, name, **how):
        kept.setdefault(name, []).append(common.Table(df, name, **how))
        return kept[name][-1]

    monkeypatch.setattr(topk, "Table", table)
    found = topk.top_k(frame, "vec_id", "embedding", F.col("vec_id") % 100 == 0, candidates=40, bins=8).collect()
    v = np.floor(np.array([r["embedding"] for r in frame.orderBy("vec_id").collect()]) * 1024).astype(np.int64)
    for q in range(0, 600, 100):
        scores = v @ v[q]
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-scores[i], i))[:10]
        assert [(r["id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, scores[i]) for i in order]
    # 15 blocks would keep 10 scores each of every query.
    assert kept["scores"][0].df.count() <= topk.FEW * 10 * 6 < 15 * 10 * 6
    rises = [t.df.groupBy("n").agg(F.min("lo").alias("lo")).agg(F.sum("lo")).first()[0] for t in kept["ranges"]]
    assert len(rises) > 2 and rises == sorted(rises) and rises[1] < rises[-1]
    assert topk.exact_quotient(np.array([[2**63 - 1, -(2**63), 5]]), np.array([[-(2**63) + 1]]), np.array([[2**53]])).tolist() == [[2047, -1, 1024]]


def test_top_k_of_few_rows_and_huge_numbers(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1)], VECTORS)
    assert [(r["id"], r["score"]) for r in topk.top_k(few, "vec_id", "embedding", F.col("vec_id") == 0).collect()] == [(1, -(1024 * 1024))]
    huge = spark.createDataFrame([(0, [3e38], 1), (1, [-3e38], 1), (2, [1.0], 1)], VECTORS)
    assert [(r["id"], r["score"]) for r in topk.top_k(huge, "vec_id", "embedding", F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 2**63 - 1), (1, -(2**63))]
    assert topk.top_k(spark.createDataFrame([], VECTORS), "vec_id", "embedding", F.col("vec_id") == 0).count() == 0
    assert topk.top_k(few, "vec_id", "embedding", F.col("vec_id") == 9).count() == 0


def test_near_vectors_agree_with_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    rows, at = [], 0
    for label in (0, 1):
        for _ in range(12):
            c = rng.normal(size=64)
            for _ in range(int(rng.integers(1, 12))):
                rows.append((at, (c + rng.normal(size=64) * rng.choice([0.0, 0.05, 0.12, 0.25])).astype(np.float32).tolist(), label))
                at += 1
    rows += [(at, rows[0][1], 0), (at + 1, rows[0][1], None), (at + 2, None, 0), (at + 3, [0.0] * 64, 0), (at + 4, [float("nan")] * 64, 0), (0, rows[0][1], 0), (None, rows[0][1], 0), (at + 5, [1.0, 2.0], 0), (at + 6, [2.0, 4.0], 0)]
    found = embed_dedup.near_vectors(clashing(spark.createDataFrame(rows, VECTORS)), block=4).collect()
    good = [k for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and any(v) and all(np.isfinite(v))]
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in good}
    link = {k: [j for j in good if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.98] for k in good}
    total = sum(map(len, link.values()))
    assert 0.95 * total <= sum(r["n_links"] for r in found) <= total and len(found) == len(rows)
    seen = {}
    for r in found:
        if r["id"] not in (None, 0):
            seen[r["id"]] = r
    for k, (i, _, _) in enumerate(rows):
        if i is None or i == 0:
            continue
        if k not in good:
            assert seen[i]["n_links"] == 0 and seen[i]["component_id"] == i and seen[i]["kept"]
        else:
            assert seen[i]["n_links"] <= len(link[k]) and seen[i]["component_id"] <= i
    assert seen[at + 5]["n_links"] == 1 and seen[at + 6]["component_id"] == at + 5
    assert embed_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_hadamard_turns_without_changing_lengths():
    x = np.random.Generator(np.random.PCG64(1)).normal(size=(3, 8))
    h = np.array([[1.0]])
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(embed_dedup.hadamard(x), x @ h)


# --- 9: chat ----------------------------------------------------------------------------------


def test_control_strings_survive_escaping(spark):
    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|image:1|>", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "/", "s>", "é", "\n", " ", "$1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("*", chat.unescape(F.col("e")).alias("u"))
    for r in frame.collect():
        assert r["u"] == r["t"] and not any(x in r["e"] for x in ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<<SYS>>"))


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "yes </s>"), (1, 0, "user", "a<|text|>b"), (1, 2, "assistant", None), (2, 0, None, "hm"), (2, 0, None, "hm"), (None, 0, "user", "x"), (3, None, "we<|text|>ird", ""), (3, 5, "assistant", "é[INST]")]
    done = chat.format_chats(clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).cache()
    back = {r["conv_id"]: r for r in chat.read_back(done).collect()}
    told = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert back[1]["turns_sha256"] == told([("user", "a<|text|>b"), ("assistant", "yes </s>"), ("assistant", "")])
    assert back[2]["turns_sha256"] == told([("", "hm"), ("", "hm")]) and back[None]["n_turns"] == 1
    assert back[3]["turns_sha256"] == told([("we<|text|>ird", ""), ("assistant", "é[INST]")])
    assert (back[1]["loss_chars"], back[1]["loss_sha256"]) == (8, hashlib.sha256(b"yes </s>").hexdigest())
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_very_long_turn_reads_back(spark):
    long = "</s>[INST] é " * 100_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, 0, "user", "x")]
    done = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: r for r in chat.read_back(done).collect()}
    assert back[1]["n_turns"] == 3 and back[1]["loss_chars"] == 2 * len(long) and back[1]["loss_sha256"] == hashlib.sha256((long * 2).encode()).hexdigest()
    assert back[2]["loss_chars"] == 0


def test_content_parts_become_ordered_placeholders(spark):
    part = lambda type_, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (type_, text, ref, width, height, seconds, pages)
    rows = [(1, 0, "user", [part("text", "see <|image:1|>"), part("image", ref="a.png", width=56, height=29), part("audio", ref="b.wav", seconds=2.1)]), (1, 1, "assistant", [part("document", ref="c.pdf", pages=3), part("text", "done")])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(frame, text=None, parts="parts").first()
    assert r["formatted"] == "<|turn|>user<|text|>see <\\|image:1|>\n<|image:1|>\n<|audio:2|></s><|turn|>assistant<|text|><|document:3|>\ndone</s>"
    assert [(a["ordinal"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, "image", "a.png", 4), (2, "audio", "b.wav", 53), (3, "document", "c.pdf", 768)]
    assert r["attachment_tokens"] == 825 and [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]] == ["<|document:3|>\ndone"]


# --- 10: HTML ---------------------------------------------------------------------------------


def test_blocks_of_broken_markup():
    text = lambda s: [b.text for b in html_extract.blocks(s)]
    assert text("<p>a <b>b\n c</b>d<p>e&amp;f&nbsp; g<br>h<li>i<li>j") == ["a b cd", "e&f g", "h", "i", "j"]
    assert text("<script>var t='</p>x';</script><style>p{}</style>y<!-- no --> z<!-- cut") == ["y z"]
    assert text('<a title="a>b">t</a> <img alt="x"> < 3') == ["t < 3"]
    assert text("<head><title>t</title><meta x></head><body>u") == ["u"] and text(None) == [] and text("<p") == []
    assert [b.path[-1] for b in html_extract.blocks('<div class="Side-bar"><p>x</div><p>y')] == ["<p", "<p"]
    assert text("<div " + 'a="' * 2000) == []


def test_the_labeller_reads_unseen_pages_and_the_tables(spark):
    from conftest import SF

    net = html_extract.fitted()
    rng, right, n = random.Random(77), 0, 0
    for _ in range(120):
        own = html_extract.blocks(html_extract.page(rng))
        clean = [html_extract.Block(b.text.replace(html_extract.MARK, "") or "-", b.path, b.linked) for b in own]
        (said,) = net.label([clean])
        right += sum(s == b.text.startswith(html_extract.MARK) for s, b in zip(said, own, strict=True))
        n += len(own)
    assert right / n > 0.97
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (90, "u", ""), (91, "u", "<nav>a</nav>")], "page_id long, url string, html string")
    found = html_extract.extract(clashing(pages.unionByName(odd)), net=net).collect()
    assert len(found) == pages.count() + 3 and [r["text"] for r in found if r["id"] in (None, 90, 91)] == ["", "", ""]
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in found:
        if r["id"] is not None and r["id"] < 90:
            inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", source[r["id"]], re.S)[1])
            import html as h

            want = [" ".join(h.unescape(x).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
            assert r["text"] == "\n".join(x for x in want if x)


def measured(net, unseen, pages=200, seed=99):
    """Precision and recall of the labels of invented blocks."""
    rng, hits, said_, gold_ = random.Random(seed), 0, 0, 0
    for _ in range(pages):
        own = html_extract.blocks(html_extract.page(rng, unseen))
        gold = np.array([b.text.startswith(html_extract.MARK) for b in own], bool)
        (said,) = net.label([[html_extract.Block(b.text.replace(html_extract.MARK, "") or "-", b.path, b.linked) for b in own]])
        hits, said_, gold_ = hits + int((gold & said).sum()), said_ + int(said.sum()), gold_ + int(gold.sum())
    return hits / said_, hits / gold_


def test_layouts_and_class_words_that_were_never_learned_from():
    assert not {x for known, unseen in html_pages.PARTS.values() for x in known if x in unseen}
    assert min(measured(html_extract.fitted(), False)) > 0.975
    assert min(measured(html_extract.fitted(), True)) > 0.95


SENTENCES = ["The river rises in the hills and runs east for forty miles.", "Its valley was settled early, as old maps show.", "Most villages lie on the northern bank.", "Floods came in spring and left good soil.", "A mill stood where the bridge is now.", "Nobody remembers who built it."]
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOTER = "<footer><p>&copy; 2021 River Society. All rights reserved.</p></footer>"
COMMENTS = '<div class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>Nice read, thank you.</p></div><div class="comment"><b>Bo</b><p>I was there in 1999.</p></div></div>'
NOTICE = '<div class="cookie-notice"><p>We use cookies to improve this site.</p><button>Accept</button></div>'


def written_page(body, begin="<article>", end="</article>", head="<h1>The river</h1>", before="", after=""):
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{before}{NAV}{begin}{head}{body}{end}{after}{FOOTER}</body></html>"


def each_in(frame):
    return "".join(frame.format(x) for x in SENTENCES)


PAIRS = [y for x in SENTENCES for y in (x.split()[1], x)]
#: Pages written by hand, whatever their article's text stands in, and the blocks of it.
WRITTEN = {
    "p": (written_page(each_in("<p>{}</p>")), ["The river", *SENTENCES]),
    "div": (written_page(each_in("<div>{}</div>")), ["The river", *SENTENCES]),
    "div in main": (written_page(each_in("<div>{}</div>"), "<main>", "</main>"), ["The river", *SENTENCES]),
    "br": (written_page("<br><br>".join(SENTENCES)), ["The river", *SENTENCES]),
    "br in div": (written_page("<br/>".join(SENTENCES), '<div class="content">', "</div>"), ["The river", *SENTENCES]),
    "dl": (written_page("<dl>" + "".join(f"<dt>{x.split()[1]}</dt><dd>{x}</dd>" for x in SENTENCES) + "</dl>"), ["The river", *PAIRS]),
    "links": (written_page(f"<p>{SENTENCES[0]}</p><ul>" + "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(SENTENCES[1:])) + "</ul>"), ["The river", *SENTENCES]),
    "table": (written_page("<table>" + each_in("<tr><td>{}</td></tr>") + "</table>"), ["The river", *SENTENCES]),
    "span": (written_page(each_in("<div><span>{}</span></div>")), ["The river", *SENTENCES]),
    "bare": (" ".join(SENTENCES), [" ".join(SENTENCES)]),
    "bare lines": ("<html><body>" + "<br>".join(SENTENCES) + "</body></html>", SENTENCES),
    "comments": (written_page(each_in("<p>{}</p>") + COMMENTS + NOTICE), ["The river", *SENTENCES]),
    "comments after": (written_page(each_in("<div>{}</div>"), after=COMMENTS + NOTICE), ["The river", *SENTENCES]),
    "notice first": (written_page("<br><br>".join(SENTENCES), "<main>", "</main>", before=NOTICE, after=COMMENTS), ["The river", *SENTENCES]),
    "aside": (written_page("".join(f"<p>{x}</p>" for x in SENTENCES[:3]) + '<aside class="related"><h3>Related</h3><a href="/x">Other rivers</a></aside>' + "".join(f"<p>{x}</p>" for x in SENTENCES[3:])), ["The river", *SENTENCES]),
    "long dl": (written_page("<dl>" + "".join(f"<dt>term {i}</dt><dd>What term {i} means in short.</dd>" for i in range(20)) + "</dl>"), ["The river", *(y for i in range(20) for y in (f"term {i}", f"What term {i} means in short."))]),
}


@pytest.mark.parametrize("kind", WRITTEN)
def test_article_text_in_any_element(kind):
    source, want = WRITTEN[kind]
    assert html_extract.main_texts(html_extract.fitted(), [source]) == ["\n".join(want)]


def test_comments_and_notices_inside_an_article_are_left_out(spark):
    text = "Some long text of the article that goes on for a while."
    rows = [
        (1, f'<body><nav><a href="/">Home</a></nav><article><h1>Title here</h1><p>{text}</p><section class="comments"><p>I do not agree with this at all.</p><p>Nice one!</p></section></article></body>', f"Title here\n{text}"),
        (2, f'<body><div class="gdpr-bar">We use cookies and so on.</div><article><h1>T</h1><p>{text}</p><p>More.</p></article>', f"T\n{text}\nMore."),
        (3, f'<body><article><p>One {text}</p><div class="cookie-banner">We use cookies.</div><p>Two {text}</p><div class="comment-section"><b>Bob</b><p>First!</p></div></article>', f"One {text}\nTwo {text}"),
        (4, "<body><article><h1>Long</h1>" + f"<p>{text}</p>" * 20_000 + "</article><footer>&copy; x</footer>", "Long" + f"\n{text}" * 20_000),
        (2, "<nav>a</nav>", ""),
        (2, "<nav>a</nav>", ""),
    ]
    found = html_extract.extract(spark.createDataFrame([(i, "u", h) for i, h, _ in rows], "page_id long, url string, html string")).collect()
    assert sorted((r["id"], r["text"]) for r in found) == sorted((i, t) for i, _, t in rows)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_gradients_of_the_labeller():
    rng = random.Random(5)
    pages = [x for x in (html_extract.blocks(html_extract.page(rng)) for _ in range(3)) if x]
    net = html_extract.Labeller(1)
    tokens, cells, dense, real = net.inputs(pages)
    scores, hidden, states = net.run(tokens, cells, dense, real)
    up = np.where(real, 1.0, 0.0)[:, :, None] * net.out
    _, du = html_extract.lstm_gradient(up[:, :, : html_extract.HIDDEN], *states[0], net.again[0], real)
    net.again[0][2, 5] += 1e-6
    after, _, _ = net.run(tokens, cells, dense, real)
    assert np.isclose((after - scores)[real].sum() / 1e-6, du[2, 5], rtol=1e-3, atol=1e-5)


def test_fingerprints_that_take_turns_send_a_bounded_number_of_rows(spark):
    from functools import reduce

    for n in (10_000, 250_000, 3_000_000, 30_000_000, 300_000_000):
        copies, width = simhash.plan(n, 0.8)
        bits = simhash.enough_bits(n, simhash.RADIUS, width, 0)
        taken = simhash.turns(copies, bits)
        assert [k for some in taken for k in some] == list(range(copies))
        assert all(len(some) * simhash.ball(2, bits) <= simhash.ROWS_A_TEXT or len(some) == 1 for some in taken)
    assert len(simhash.turns(35, simhash.enough_bits(3_000_000, 4, 36, 0))) == 1
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**32, (40, 6), dtype=np.uint64)
    values = np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 30)]).astype("<u4")
    classes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(values)], "c long, signature binary")
    roots = lambda df: sorted(map(tuple, common.connected_components(df).collect()))
    every = roots(simhash.fellows(classes, 6, 32, 1))
    for bits in (0, 3):
        some = [simhash.fellows(classes, 6, 32, bits, only=range(i, i + 2)) for i in (0, 2, 4)]
        assert roots(reduce(lambda a, b: a.union(b), some)) == every and len(every) == 120
