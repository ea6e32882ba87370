"""BPE, licences and the finding of random strings on small fixtures."""

import hashlib
import re

import numpy as np
import pytest

from fixtures import EDGES, frame, prose


def test_bpe_is_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    from pennant.llm import bpe

    path = P.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    texts = EDGES[:-1] + ["it's <|endoftext|> 12 ½ été\n\n  日本 😀", "a" * 3000, "the " * 500, prose(1, 50)]
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(frame(spark, texts).limit(0), path).count() == 0


def test_lexicon_shares_and_finds():
    from pennant.llm import bpe

    words = {b"walking": [1, 2], b"talking": [3], b"walked": [4], b"a": [5], b"": [9]}
    words.pop(b"")
    states = bpe.minimal_automaton(sorted(words))
    assert len(states) < sum(map(len, words))
    data = bpe.compile_lexicon(words)
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(data)
        f.flush()
        lex = bpe.Lexicon(f.name)
        assert all(lex.get(w) == np.array(ids, "<u4").tobytes() for w, ids in words.items())
        assert lex.get(b"walk") is None and lex.get(b"zzz") is None


def test_secrets(spark):
    from pennant.llm import secrets

    texts = ["password=abcdef1 x", "AKIA" + "B" * 16, "f" * 24, "key iK2ZWeqhFWCEPyYngFb51yBM here", "just some_words_in_a_long_identifier_name", None, ""]
    got = {r.doc_id: r for r in secrets.secret_digests(frame(spark, texts)).collect()}
    assert (got[0].n_assign, got[1].n_access, got[2].n_hex) == (1, 1, 1)
    assert got[3].spans == "random:4:28" and got[4].spans == "" and got[5].spans == "" and got[6].spans == ""
    assert secrets.secret_digests(frame(spark, texts).limit(0)).count() == 0


def test_random_strings_are_found_among_wordlike_ones(spark):
    from pennant.llm import secrets

    r = np.random.default_rng(7)
    sets = {name: list(alphabet) for name, alphabet, *_ in secrets.ENCODINGS}
    keys = ["".join(r.choice(sets[e], n)) for e in ("base32", "base36", "base62") for n in (20, 24, 32) for _ in range(100)]
    names = ["".join(r.choice(["Stream", "Reader", "Table", "Handler", "Factory", "Index2", "Remote"], 5)) for _ in range(2000)]
    got = {x.doc_id: x.spans for x in secrets.secret_digests(frame(spark, [*keys, "x RtqZKbGwvMxuJfLDyhPc y", *names])).collect()}
    assert sum(got[i] == f"random:0:{len(k)}" for i, k in enumerate(keys)) >= 0.98 * len(keys)
    assert got[len(keys)] == "random:2:22"
    assert sum(got[len(keys) + 1 + i] == "" for i in range(len(names))) >= 0.95 * len(names)


def test_licenses(spark):
    from pennant.llm import licenses

    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, ["Hello\nReleased under the MIT licence.\nbye", "Copyright (c) 2020 X\nLicensed under the MIT License", None])).collect()}
    assert got[0].notices == "MIT:2" and got[0].license is None and got[1].license == "MIT" and got[2].n_notices == 0


ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""


def test_full_licenses_and_copyright_lines(spark):
    from pennant.llm import licenses

    heads = ["Copyright Jane Doe 2020", "// Copyright (c) 2020 X", "# Copyright Jane Doe", "Copyright law applies here"]
    texts = [ZLIB, *[f"{h}\nLicensed under the MIT License" for h in heads]]
    got = {r.doc_id: r.license for r in licenses.license_scan(frame(spark, texts)).collect()}
    assert got == {0: "Zlib", 1: "MIT", 2: "MIT", 3: "MIT", 4: None}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= {x for x, _ in licenses.FULL_TEXTS}


UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <"""


def full_texts():
    """Licence texts that are on this machine: (licence, text), those of the GNU project also without their appendix."""
    import importlib.metadata as metadata
    from pathlib import Path

    found = [("Zlib", ZLIB), *[("Unlicense", UNLICENSE + end) for end in ("https://unlicense.org>", "https://unlicense.org/>", "http://unlicense.org/>")]]
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    for name, licence in names.items():
        file = Path("/usr/share/common-licenses") / name
        if file.exists():
            text = file.read_text()
            found.append((licence, text))
            end = "END OF TERMS AND CONDITIONS"
            if end in text:
                found += [(licence, text[: text.index(end)]), (licence, text[: text.index(end)] + end)]
    for package in ("requests", "packaging", "tzdata"):
        try:
            files = [f for f in metadata.files(package) or [] if "LICENSE" in f.name]
        except metadata.PackageNotFoundError:
            continue
        found += [("Apache-2.0", t) for f in files if "Apache License" in (t := f.locate().read_text())]
    return found


def test_every_digest_has_a_text(spark):
    """Each digest of a full text is that of a text on this machine, under the licence's name."""
    from pathlib import Path

    from pyspark.sql import functions as F

    from pennant.llm import licenses

    texts = full_texts()
    rows = spark.createDataFrame(texts, "license string, text string").select("license", licenses.digest(F.col("text")).alias("d")).collect()
    of = {r.d: r.license for r in rows}
    known = {d: name for name, d in licenses.FULL_TEXTS}
    assert all(of[d] == known[d] for d in of if d in known) and {"Zlib", "Unlicense"} <= {known[d] for d in known if d in of}
    if Path("/usr/share/common-licenses/MPL-2.0").exists():
        assert [(known[d], d) for d in known if d not in of] == []


def test_copyright_lines_of_any_length(spark):
    """Long lines of names and years are dropped whole, in Spark and in SQL."""
    import duckdb

    from pennant.llm import licenses

    grant = "Licensed under the MIT License"
    heads = ["Copyright (c) 2020 " + "x" * 150, "Copyright " + "Jane Doe, " * 30 + "2020", "Copyright 2019-2021 " + "some words " * 3000, "Copyright " + " ".join(["Ann"] * 9000), "Copyright Jane von Doe", "copyright notice of 2020", "# (c) Jane 1999", "   * All Rights Reserved.", "Copyright [yyyy] [name]", "(c) x, a law of 1990"]
    docs = frame(spark, [f"{h}\n{grant}" for h in heads] + [f"{grant}\r\n© 2001", "", None])
    plain = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: r[0])
    got = plain(licenses.license_scan(docs).collect())
    assert [g[1] for g in got] == ["MIT"] * 4 + [None, None] + ["MIT"] * 3 + [None, "MIT", None, None]
    documents = docs.toPandas()  # noqa: F841  read by name
    assert plain(duckdb.sql(licenses.SQL).fetchall()) == got


def test_own_license_table_needs_no_mark(spark):
    from pennant.llm import licenses

    own = licenses.known_licenses(spark, [("House", "All our words are free.")])
    assert licenses.license_scan(frame(spark, ["x\nAll our words are FREE"]), own).first().notices == "House:2"


def test_quality_learns(spark):
    from pennant.llm import quality

    good, bad = [prose(i, 40) for i in range(60)], [prose(i, 40).upper().replace(" ", "!! ") for i in range(60)]
    docs = frame(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    rows = quality.quality_scores(docs, labels).collect()
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 122
    held = [r for r in rows if r.held_out and r.doc_id < 120]
    assert held and sum(r.predicted == int(r.doc_id < 60) for r in held) / len(held) > 0.9
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_bpe_and_licenses_keep_clashing_columns_and_take_empty_tables(spark):
    import public_tokenizers as P
    from fixtures import CLASHES, clashing

    from pennant.llm import bpe, licenses

    docs = clashing(spark, ["the cat", "the cat", None, ""])
    out = bpe.encode(docs, P.path("byte_bpe_50k.json"), col="token_ids")
    assert all(r[c] == v for r in out.collect() for c, v in CLASHES.items())
    assert set(bpe.encode(docs, P.path("byte_bpe_50k.json")).columns) == set(docs.columns)
    again = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "other"), (None, "Released under the MIT License."), (2, None), (3, "x" * 2_000_000)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.license or "", r.n_notices) for r in licenses.license_scan(again).collect())
    assert got == [("1", "", 0), ("1", "MIT", 1), ("1", "MIT", 1), ("2", "", 0), ("3", "", 0), ("None", "MIT", 1)]
    assert licenses.license_scan(docs.limit(0)).count() == 0 and licenses.license_scan(docs).columns == ["doc_id", "license", "n_notices", "notices"]


def test_bpe_refuses_settings_it_does_not_follow(tmp_path):
    import json

    import public_tokenizers as P

    from pennant.llm import bpe

    told = json.loads(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())  # noqa: SIM115
    told["pre_tokenizer"]["add_prefix_space"] = True
    told["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="pre_tokenizer, added_tokens"):
        bpe.Vocabulary(str(tmp_path / "t.json"))
