"""The corpus operators against plain Python and on awkward rows."""

import base64
import hashlib
import itertools
import math
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinara.llm import bpe, chat, exact_dedup, licenses, packing, quality, queries, sharding, simhash, toxicity, url_filter
from opinara.llm.components import connected
from opinara.llm.oracle import ORACLE
from tests.check_oracle import canonical, connect

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, rank int, size string, score string"
LONG = "lorem  ipsum\tdolor " * 20_000
TEXTS = [
    None,
    "",
    " \t\n",
    "a",
    "A b c",
    "a b  c",
    "it's <|endoftext|> naïve café 12345 \u00a0 x\u2003y \u0301e \r\n\n  ok  ",
    "日本語 текст 🙂🙂 'll 'S \x1c\x85 end ",
    "the quick brown fox jumps over the lazy dog " * 3,
    "the quick brown fox jumps over the lazy dog " * 3,
    LONG,
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, a repeated and a missing id, clashing column names."""
    rows = [(i, t, "en" if i % 2 else None, None, None, 1, 2, "s", "x") for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "xx", "s", 1, 0, 0, "", ""), (None, "a", "de", "s", 1, 0, 0, "", ""), (-3, "a b", "fr", "s", 1, 0, 0, "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def pairs(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


# 1: encoding


def reference_encoding():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_encoding_is_that_of_the_library(awkward, documents, block_bytes):
    path, encoding = reference_encoding()
    docs = awkward.select("doc_id", "text", "kept") if block_bytes == 1 else documents
    apart = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, block_bytes=block_bytes), path)
    at_once = bpe.encode(docs, path, public_tokenizers.PATTERN, block_bytes=block_bytes, decoded=True)
    ids = lambda t: struct.pack(f"<{len(x := encoding.encode_ordinary(t))}I", *x)
    expected = Counter((d, ids(t), t.encode()) for d, t in pairs(docs))
    for out in (apart, at_once):
        assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out.collect()) == expected


def test_pattern_cuts_every_code_point_alike():
    """The library that cuts agrees with the one that encodes on letters, numbers and white space."""
    import regex

    _, encoding = reference_encoding()
    find = regex.compile(public_tokenizers.PATTERN).findall
    for start in range(0, 0x3400, 64):
        text = " ".join(f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)} " for c in range(start, start + 64))
        assert [i for w in find(text) for i in encoding._core_bpe.encode_single_piece(w.encode())] == encoding.encode_ordinary(text)


def test_encoding_of_nothing(nothing):
    path, _ = reference_encoding()
    assert bpe.decode(bpe.encode(nothing, path, public_tokenizers.PATTERN), path).count() == 0
    assert bpe.encode(nothing, path, public_tokenizers.PATTERN, decoded=True).columns == ["doc_id", "ids", "decoded"]


# 2: exact dedup


def brute_groups(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((len(text), doc_id))
    keep = {}
    for norm, members in groups.items():
        best = max(members, key=lambda m: (m[0], m[1] is not None, -(m[1] or 0)))
        keep[norm] = (best[1], len(members))
    return Counter((d, *keep[re.sub(r"[\x20\x09-\x0D]", "", t)]) for d, t in docs)


@pytest.mark.parametrize("digest", ["sha256", "length"])
def test_exact_groups(awkward, digest):
    """Also where many texts share a digest."""
    chosen = exact_dedup.sha256 if digest == "sha256" else lambda t: F.char_length(t) % 2
    out = exact_dedup.exact_groups(awkward, digest=chosen).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == brute_groups(pairs(awkward))
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out)


def test_longest_original_wins(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "a  b"), (3, "a b "), (9, "é"), (8, "é")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs).collect()} == {1: 2, 2: 2, 3: 2, 8: 8, 9: 8}
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()) == [2, 8]


def test_hot_text_and_salts(spark):
    docs = spark.range(400).repartition(9).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    for salts in (1, 4):
        out = exact_dedup.exact_groups(docs, salts=salts)
        assert out.filter("kept").count() == 1 + 134
        assert out.agg(F.max("group_size")).first()[0] == 266


def test_exact_groups_of_nothing(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0


# 3: toxicity


def test_machine_learns_a_pair(spark):
    """Two terms that only mean something together: no sum of single weights separates them."""
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], float)
    bias, w, v = toxicity.train(x, np.array([0.0, 0, 0, 1]), np.ones(4))
    score = lambda r: bias + r @ w + ((r @ v) ** 2 - (r**2) @ v**2).sum() / 2
    assert all((score(r) > 0) == (r.sum() == 2) for r in x)
    bias, w, v = toxicity.train(x, np.array([1.0, 0, 0, 1]), np.ones(4), rounds=2000)
    assert all((score(r) > 0) == (r.sum() != 1) for r in x)


def labelled_texts(spark, kind, n, seed):
    """Random words, and what makes a row toxic: one of two words, both of them, or any word of a large set."""
    random = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        noise = [f"n{k}" for k in random.choice(2000, 20)]
        if kind == "one of two":
            first, second = random.random(2) < 0.5
            toxic, more = first != second, ["alpha"] * int(first) + ["beta"] * int(second)
        elif kind == "both":
            draw = random.random()
            toxic, more = draw < 0.1, ["alpha", "beta"] if draw < 0.1 else ["alpha"] if draw < 0.2 else ["beta"] if draw < 0.3 else []
        else:
            toxic = random.random() < 0.5
            more = [("bad" if toxic else "good") + str(random.integers(200))]
        rows.append((i, " ".join([*noise, *more]), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    return table.drop("toxic"), table.drop("text"), rows


@pytest.mark.parametrize("kind", ["one of two", "both", "any of many"])
def test_fit_finds_what_tells(spark, kind):
    """Words that tell nothing alone, and many words that each tell a little, are learned from texts."""
    docs, labels, _ = labelled_texts(spark, kind, 5000, 1)
    model = toxicity.fit(docs, labels)
    _, _, fresh = labelled_texts(spark, kind, 600, 2)
    right = [(model.score_text(text) >= 0.5) == (toxic == 1) for _, text, toxic in fresh]
    assert sum(right) / len(right) > (0.9 if kind == "any of many" else 0.99)
    if kind != "any of many":
        assert len(model.terms) < 20


def test_machine_by_all_pairs():
    """Logits and gradients of the sparse rows against sums over every pair of terms."""
    random = np.random.default_rng(3)
    x = (random.random((30, 12)) < 0.3).astype(float)
    x[4] = 0
    rows = toxicity.Rows.of(x)
    b, w, v = np.array([0.2]), random.normal(size=12), random.normal(size=(12, toxicity.FACTORS))

    def brute(w, v):
        return [0.2 + r @ w + sum(r[i] * r[j] * (v[i] @ v[j]) for i in range(12) for j in range(i + 1, 12)) for r in x]

    logit, total = rows.logits(b, w, v)
    assert np.allclose(logit, brute(w, v))
    error, step = random.normal(size=30), 1e-6
    by_w, by_v = rows.gradients(error, total, v)
    for place, value, vector in zip(rows.used, by_w, by_v):
        moved = w.copy()
        moved[place] += step
        assert abs(error @ (np.array(brute(moved, v)) - logit) / step - value) < 1e-4
        moved = v.copy()
        moved[place, 1] += step
        assert abs(error @ (np.array(brute(w, moved)) - logit) / step - vector[1]) < 1e-4
    some = rows.take(np.array([7, 4, 2])).columns(np.array([5, 0, 9]))
    assert (some.dense() == x[[7, 4, 2]][:, [5, 0, 9]]).all()


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    out = queries.op3_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    table = {(r["toxic"], r["predicted"]): r["n"] for r in out.filter("held_out").groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    caught, missed = table.get((1, 1), 0), table.get((1, 0), 0)
    # Some of the toxic rows hold nothing but repeated junk, and some clean ones words that begin like a toxic one.
    assert caught / (caught + missed) > 0.8
    assert table.get((0, 1), 0) / table[(0, 0)] < 0.01


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)] + [(None, 1), (3, None), (8, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(awkward, labels)
    scores = [r[0] for r in awkward.select(model.score(F.col("text"))).collect()]
    assert len(scores) == awkward.count() and all(0 <= s <= 1 for s in scores)
    for none in (toxicity.fit(nothing, labels), toxicity.fit(awkward, labels.limit(0))):
        assert none.score_text("any") < 1e-6
    assert nothing.select(model.score(F.col("text"))).count() == 0


def test_rows_to_learn_from(spark):
    for i in range(50):
        expected = zlib.crc32(str(i).encode()) % 3 != 1
        assert spark.range(i, i + 1).select(toxicity.in_training(F.col("id"))).first()[0] == expected


# 4: url filter


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, host int, rule string")


def test_url_parts_and_rules(spark):
    given = {
        "https://A.Example.ORG/en/12?x": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
        "http://example.org": ("example.org", "", None, None),
        "http://notexample.org/es/x": ("notexample.org", "/es/x", "org/", "allow"),
        "ftp://b.com/fr/1#y": ("b.com", "/fr/1", "com/fr/", "allow"),
        "x://y://z/de/": ("y:", "//z/de/", None, None),
        "http://q?a=://b/": ("q", "", None, None),
        "no scheme/es/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    out = url_filter.judge(pages(spark, [(i, u, None, 1, "") for i, u in enumerate(given)])).collect()
    for r in out:
        host, path, rule, verdict = list(given.values())[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict in (None, r["verdict"])


def brute_mass(hosts, edges, rounds, damping):
    out = {}
    for kind, directed in (("trust", edges), ("distrust", [(b, a, n) for a, b, n in edges])):
        seed = {k: (1 - damping) * h[kind] for k, h in hosts.items() if h[kind]}
        flow, mass = defaultdict(float), dict(seed)
        for a, _, n in directed:
            flow[a] += n
        for _ in range(rounds):
            new = defaultdict(float, seed)
            for a, b, n in directed:
                new[b] += damping * mass.get(a, 0) * n / flow[a]
            mass = new
        out |= {(kind, k): v for k, v in mass.items()}
    return out


def test_distrust_flows_against_links(spark):
    link = lambda *to: "".join(f'<a HREF = "https://{t}/p">' for t in to)
    rows = [
        (1, "http://bad.example.org/es/1", link("good.net")),
        (2, "http://fan.net/x", link("bad.example.org", "bad.example.org", "other.net")),
        (3, "http://good.org/a", link("friend.net")),
        (4, "http://friend.net/", None),
        (5, "http://other.net/", ""),
    ]
    out = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages(spark, [(*r, 0, "") for r in rows])).collect()}
    assert out == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_propagation_against_plain_python(spark):
    random = np.random.default_rng(3)
    hosts = {f"h{i}": {"trust": int(random.integers(0, 3)), "distrust": int(random.integers(0, 3))} for i in range(12)}
    edges = [(f"h{a}", f"h{b}", int(random.integers(1, 5))) for a, b in {tuple(random.integers(0, 12, 2)) for _ in range(40)} if a != b]
    seeds = [(k, h, float(v[k])) for h, v in hosts.items() for k in ("trust", "distrust") if v[k]]
    mass = url_filter.propagate(
        spark.createDataFrame(seeds, "kind string, host string, mass double"), spark.createDataFrame(edges, "src string, dst string, n bigint"), 1e-4
    )
    got, expected = {(r["kind"], r["host"]): r["mass"] for r in mass.collect()}, brute_mass(hosts, edges, 300, url_filter.DAMPING)
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], rel_tol=1e-2) for k in got)


def test_unrelated_pages_change_no_verdict(spark):
    link = lambda to: f'<a href="https://{to}/">'
    linkers = [(i, f"http://linker{i}.net/", link("bad.example.org")) for i in range(300)]
    chain = [(1000 + i, f"http://chain{i}.net/", link(f"chain{i - 1}.net" if i else "bad.example.org")) for i in range(12)]
    friends = [(2000 + i, f"http://friend{i}.net/", None) for i in range(3)] + [(2100, "http://good.org/a", "".join(link(f"friend{i}.net") for i in range(3)))]
    rows = [(-1, "http://bad.example.org/es/1", None), *linkers, *chain, *friends]
    unrelated = [(10_000 + i, f"http://x{i}.example.org/es/1", None) for i in range(500)] + [(20_000 + i, f"http://y{i}.org/", None) for i in range(500)]
    for more in ([], unrelated):
        out = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages(spark, [(*r, 0, "") for r in rows + more])).collect()}
        assert {out[r[0]] for r in linkers} == {out[r[0]] for r in chain} == {"block"}
        assert {out[r[0]] for r in friends} == {"allow"}
    twice = url_filter.judge(pages(spark, [(*r, 0, "") for r in rows + rows])).collect()
    assert len(twice) == 2 * len(rows) and {r["verdict"] for r in twice if r["page_id"] < 2000} == {"block"}
    long = [(1, "http://long.net/", "<p>lorem ipsum</p>" * 100_000 + link("bad.example.org")), rows[0]]
    assert {r["verdict"] for r in url_filter.judge(pages(spark, [(*r, 0, "") for r in long])).collect()} == {"block"}


def test_urls_of_nothing(spark):
    assert url_filter.judge(pages(spark, [])).count() == 0


# 5: packing


def test_chunks_give_the_tokenizers_ids(documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.ChunkEncoder(path)
    for text in [t or "" for t in TEXTS] + [t for _, t in pairs(documents)] + ["<|startoftext|>A <|ENDOFTEXT|> ΑΣ İ A\u030a \x1f e\u0301\u0323"]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def check_packing(docs, rows, capacity):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for doc_id, text in docs:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected[(doc_id, n, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_of_awkward_rows(awkward, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packing(pairs(awkward), packing.pack(awkward, path).collect(), 2048)
    assert packing.pack(nothing, path).count() == 0


def test_packing_is_near_the_bound(spark, documents):
    rows = packing.pack(documents, public_tokenizers.path("word_bpe_49k.json")).collect()
    n = check_packing(pairs(documents), rows, 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1


def fewest_bins(sizes, capacity):
    """Exact, by trying every bin for every piece."""
    best = [len(sizes)]

    def place(left, bins):
        if len(bins) >= best[0]:
            return
        if not left:
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + left[0] <= capacity and bins[i] not in bins[:i]:
                place(left[1:], [*bins[:i], bins[i] + left[0], *bins[i + 1 :]])
        place(left[1:], [*bins, left[0]])

    place(sorted(sizes, reverse=True), [])
    return best[0]


def test_bin_completion_against_exhaustive_search():
    random = np.random.default_rng(1)
    for _ in range(150):
        capacity = int(random.integers(8, 24))
        sizes = random.integers(1, capacity + 1, int(random.integers(1, 11))).tolist()
        patterns = packing.complete_bins(np.bincount(sizes, minlength=capacity + 1), capacity)
        used = Counter()
        for p in patterns:
            assert sum(a * n for a, n in p.items) <= capacity
            for a, n in p.items:
                used[a] += n * p.copies
        assert used == Counter(sizes)
        assert packing.bins(patterns) == fewest_bins(sizes, capacity)


# 6: licences


def test_licenses(spark, nothing):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
        "this work is  LICENSED under the gnu general public license version 2": "gpl-2.0",
        "x\nReleased under the MIT License.\nAll rights reserved.": "all-rights-reserved,mit",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0",
        "Our code, as said before: Released under the MIT License. Have fun with it": "mit",
        "The rights of the public were reserved under a license of the city.": None,
        "Licensed under": None,
        "": None,
        None: None,
    }
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(lines)], "doc_id bigint, text string, license int")
    out = {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()}
    assert out == dict(enumerate(lines.values()))
    assert licenses.scan(nothing).count() == 0


def wrapped(text, width, mark="", end=""):
    words, lines = text.split(" "), [""]
    for word in words:
        if len(lines[-1]) + len(word) > width:
            lines.append("")
        lines[-1] = f"{lines[-1]} {word}".strip()
    return "\n".join(f"{mark}{line}{end}" for line in lines)


@pytest.fixture(scope="module")
def licence_model():
    return licenses.fit_templates([f"we had the {w} of the day and the general mood was public" for w in ("soup", "fish", "rice", "cake")])


LICENCE_FORMS = {
    "as it is": lambda t: t,
    "over lines": lambda t: wrapped(t, 24),
    "a word a line": lambda t: t.replace(" ", "\n"),
    "in hashes": lambda t: f"# Copyright 2020 A. Person\n#\n{wrapped(t, 30, '# ')}\n#\nimport os",
    "in stars": lambda t: f"/*\n{wrapped(t, 40, ' * ')}\n */\nint main() {{ return 0; }}",
    "after prose": lambda t: f"The soup was good and the fish was better. {wrapped(t, 40)} See you again",
}


@pytest.mark.parametrize("form", LICENCE_FORMS)
def test_licence_templates_in_every_form(licence_model, form):
    for family, texts in licenses.all_templates().items():
        for text in texts:
            confirmed = {f.family for f in licence_model.find(LICENCE_FORMS[form](text)) if f.confirmed}
            assert confirmed == {family}, text


def test_licence_notices_side_by_side(licence_model):
    notices = [(family, t) for family, texts in licenses.all_templates().items() for t in texts]
    for (family, t), (other, u) in zip(notices, notices[5:] + notices[:5]):
        for between in ("\n\n", "\n//\n"):
            text = wrapped(t, 30) + between + wrapped(u, 30)
            assert {f.family for f in licence_model.find(text) if f.confirmed} == {family, other}, text
    found = licence_model.find("one\ntwo\n" + wrapped(licenses.TEMPLATES["mit"][1], 30) + "\n\nAll rights\nreserved.")
    assert [(f.line, f.family) for f in found] == [(2, "mit"), (8, "all-rights-reserved")]


def test_licence_words_that_are_no_notice(licence_model):
    for text in (
        "We are permitted to use the source.\nThis program is free software in spirit.\nThe public domain is wide.",
        "SPDX-License-Identifier: none of these",
        "All of the rights\nwere reserved for the public",
        "",
        "\n#\n*\n",
    ):
        assert not [f for f in licence_model.find(text) if f.confirmed], text


def test_licences_in_a_very_long_text(licence_model):
    notice = licenses.TEMPLATES["mit"][1]
    text = " ".join(["soup", notice] * 2000) + "\n" + "word " * 200_000 + "\n\n" + wrapped(licenses.TEMPLATES["gpl-2.0"][1], 20)
    start = time.time()
    found = {f.family for f in licence_model.find(text) if f.confirmed}
    assert found == {"mit", "gpl-2.0"} and time.time() - start < 30


def test_licences_of_repeated_rows(spark, licence_model):
    docs = spark.createDataFrame([(1, "Licensed\nunder CC BY 4.0.")] * 2 + [(None, None)], "doc_id bigint, text string")
    out = sorted(((r["doc_id"], r["license"]) for r in licenses.scan(docs, licence_model).collect()), key=str)
    assert out == [(1, "cc-by-4.0"), (1, "cc-by-4.0"), (None, None)]


def test_licenses_of_the_documents(spark, documents):
    notices = {t: family for family, texts in licenses.TEMPLATES.items() for t in texts}
    expected = {d: ",".join(sorted({notices[x] for x in t.split("\n") if x in notices})) or None for d, t in pairs(documents)}
    out = queries.op6_license_scan(spark, FOLDER).collect()
    got = {r["doc_id"]: r["license"] for r in out}
    assert got == expected and any(got.values())


# 7: sharding


def brute_shard(key, weights):
    def score(s):
        u = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 1) / float(16**13 + 1)
        return math.log(u) / weights[s], -s

    return max(range(len(weights)), key=score)


def test_sharding(spark, awkward, nothing):
    out = sharding.shard(awkward, [1.0] * 24, parts=3).collect()
    texts = Counter((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in pairs(awkward))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == texts
    for r in out:
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == brute_shard(key, [1.0] * 24) and r["grown_shard"] == brute_shard(key, [1.0] * 25)
    assert sharding.shard(nothing, [1.0]).count() == 0


def test_slots_weights_and_growth(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    weights = [1.0, 2.0, 3.0]
    out = sharding.shard(docs, weights, grown_by=2.0, parts=7).collect()
    for s, w in enumerate(weights):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
        assert abs(len(slots) / 6000 - w / 6) < 0.03
    assert all(r["grown_shard"] in (r["shard"], 3) for r in out)
    assert abs(sum(r["grown_shard"] == 3 for r in out) / 6000 - 0.25) < 0.03


# 8: SimHash


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, limit):
    """``nodes``: (id, fingerprint); smallest id reachable for each."""
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(nodes)), 2):
        if (nodes[i][1] ^ nodes[j][1]).bit_count() <= limit:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(nodes):
        least[find(i)].append(doc_id)
    known = {r: min((d for d in ids if d is not None), default=None) for r, ids in least.items()}
    return [known[find(i)] for i in range(len(nodes))]


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_near_groups(request, which):
    docs = request.getfixturevalue(which)
    rows = sorted(((d, brute_fingerprint(t)) for d, t in pairs(docs)), key=lambda r: (r[0] is None, r[0] or 0))
    expected = Counter((d, fp, c) for (d, fp), c in zip(rows, brute_components(rows, 2)))
    out = simhash.near_groups(docs).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in out) == expected


@pytest.mark.parametrize("limit", [0, 1, 2])
@pytest.mark.parametrize("pair_bucket", [1, 4, 1000])
def test_links_lose_nothing(spark, limit, pair_bucket):
    """Clusters of fingerprints a few bits apart, in light and in dense buckets, against all pairs."""
    random = np.random.default_rng(limit)
    prints = {int(x) for x in random.integers(0, 1 << 63, 60)}
    for centre in list(prints)[:6]:
        for _ in range(25):
            flips = random.integers(0, 64, int(random.integers(1, 5)))
            prints.add(centre ^ sum(1 << int(b) for b in set(flips.tolist())))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    edges = simhash.links(frame, limit, pair_bucket)
    rows = edges.collect()
    assert all((r["a"] % (1 << 64) ^ r["b"] % (1 << 64)).bit_count() <= limit for r in rows)
    roots = {r["node"]: r["root"] for r in connected(edges).frame.collect()}
    expected = brute_components([(p, p % (1 << 64)) for p in signed], limit)
    assert [roots.get(p, p) for p in signed] == expected


def test_allocation_keeps_the_principle():
    """Thresholds always use up the limit, whatever the number of fingerprints, and larger inputs get finer parts."""
    random = np.random.default_rng(0)
    bits = random.integers(0, 2, (500, 64)).astype(float)
    for n in (500, 10**6, 3 * 10**10):
        plan = simhash.allocate(n, bits.T @ bits / 500 * n, 2)
        assert sum(t + 1 for _, t in plan) == 3
        used = [b for part, _ in plan for b in part]
        assert len(used) == len(set(used))
    assert len(plan) < 3


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (None, 3)]
    found = connected(spark.createDataFrame(edges, "a bigint, b bigint")).frame.collect()
    assert {r["node"]: r["root"] for r in found} == {**{i: 1 for i in range(1, 201)}, **{i: 1000 for i in range(1000, 1300)}}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).frame.count() == 0


def test_near_groups_of_nothing(nothing):
    assert simhash.near_groups(nothing).count() == 0


# 9: quality


def test_quality_of_awkward_rows(spark, awkward, nothing):
    out = quality.judged(awkward).collect()
    assert len(out) == awkward.count()
    for r in out:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", r["row"]["text"] or "") if w]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(repeated))
        assert r["kept"] is not None and r["base_failed"] is not None
    assert quality.judged(nothing).count() == quality.judged(nothing, carry=["doc_id"]).count() == 0
    assert quality.keep_good(awkward).columns == awkward.columns


def test_divergence_by_hand(spark):
    row = spark.range(1).select(
        quality.divergence(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("apart"),
        quality.divergence(F.array(F.lit(0.3), F.lit(0.7)), F.array(F.lit(0.3), F.lit(0.7))).alias("same"),
    ).first()
    assert math.isclose(row["apart"], 1) and row["same"] == 0


def test_clean_stays_and_junk_goes(spark):
    folder = "/root/testdata/sf0.1"
    out = queries.op9_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = {(r["quality"], r["kept"]): r["n"] for r in out.filter("n_words >= 20").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert rows.get((1, False), 0) / rows[(1, True)] < 0.002
    assert rows[(0, False)] / (rows[(0, False)] + rows.get((0, True), 0)) > 0.85


# 10: chat


def brute_chat(turns):
    chats = defaultdict(list)
    for conv, turn, role, text in turns:
        chats[conv].append((-(10**9) if turn is None else turn, role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in chats.items()}


def test_chat_round_trip(spark):
    odd = [r"<|end|>", r"<\|turn|>", r"a<\\|role|>b", "<", "|turn|>", r"\\", "", None, "x" * 50_000, "é🙂<|end|><|end|>", r"\### Assistant: </turn> ok"]
    turns = [(1, i, ("user", "assistant", "assistant", None, "<|turn|>")[i % 5], t) for i, t in enumerate(odd)]
    turns += [(2, None, "assistant", "z"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (None, 0, "user", "q"), (3, 0, "user", "")]
    frame = spark.createDataFrame([(*t, 1, "f") for t in turns], "conv_id bigint, turn bigint, role string, text string, loss_mask int, formatted string")
    chats = chat.format_chats(frame)
    out = chats.select("conv_id", "formatted", "loss_mask", chat.read_turns(F.col("formatted")).alias("t"), chat.learned_text(F.col("formatted"), F.col("loss_mask")).alias("l"))
    expected = brute_chat(turns)
    rows = out.collect()
    assert {r["conv_id"] for r in rows} == set(expected)
    for r in rows:
        assert [tuple(t) for t in r["t"]] == expected[r["conv_id"]]
        assert r["l"] == "".join(t for role, t in expected[r["conv_id"]] if role == "assistant")
    two = next(r["formatted"] for r in rows if r["conv_id"] == 2)
    assert two == "<|role|>assistant<|turn|>z<|end|><|role|>user<|turn|>a<|turn|>a<|turn|>b<|end|>"
    assert chat.format_chats(frame.limit(0)).count() == 0


# SQL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    got, expected = canonical(queries.QUERIES[name](spark, FOLDER).toPandas()), canonical(connect(FOLDER).execute(ORACLE[name]).df())
    assert got == expected
