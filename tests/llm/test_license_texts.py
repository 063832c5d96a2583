import textwrap

import duckdb
import pyarrow as pa
import pytest

from cadenza.llm import license_scan, queries

MIT, ISC, ZLIB = (license_scan.LICENSES[k] for k in ("MIT", "ISC", "Zlib"))


def full(name):
    return (license_scan.FOLDER / f"{name}.txt").read_text("utf-8")


def filled(text):
    return "\n".join(textwrap.fill(p, 70) for p in text.split("\n"))


APACHE = full("Apache-2.0")
CASES = [
    ("MIT License\n\nCopyright (c) 2021 Contoso Ltd.\n\n" + filled(MIT), "MIT"),
    ("The MIT License (MIT)\n\nCopyright (c) Contoso Ltd.\n\n" + filled(MIT), "MIT"),
    ("Copyright (c) Contoso Ltd.\nAll rights reserved.\n\n" + MIT, "MIT"),
    ("ISC License\n\nCopyright (c) 2004-2010 A. Person\n\n" + filled(ISC), "ISC"),
    ("zlib License\n\n(C) A. Person\n\n" + ZLIB, "Zlib"),
    ("BSD 3-Clause License\n\nCopyright (c) 2020, Contoso Ltd.\nAll rights reserved.\n\n" + filled(full("BSD-3-Clause")), "BSD-3-Clause"),
    ("BSD 2-Clause License\n\nCopyright (c) Contoso Ltd.\n\n" + filled(full("BSD-2-Clause")), "BSD-2-Clause"),
    (APACHE.replace("[yyyy] [name of copyright owner]", "2019 Contoso Ltd."), "Apache-2.0"),
    (APACHE[: APACHE.index("APPENDIX")], "Apache-2.0"),
    (APACHE[APACHE.index("TERMS AND CONDITIONS") :], "Apache-2.0"),
    *((full(n), n) for n in "Apache-2.0 CC0-1.0 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 MPL-1.1 MPL-2.0 GFDL-1.2 GFDL-1.3 Artistic-1.0-Perl".split()),
    (full("BSD-3-Clause.regents"), "BSD-3-Clause"),
    *((full(n), n) for n in "Unlicense BSL-1.0 BlueOak-1.0.0 0BSD".split()),
    # Heads of any length, and holders by name.
    *(("MIT License\n\n" + "\n".join(f"Copyright (c) Holder {chr(65 + i)}" for i in range(n)) + "\n\n" + filled(MIT), "MIT") for n in (10, 11, 12, 15, 60)),
    ("BSD 3-Clause License\n\nCopyright (c) 2020, Contoso Ltd.\n\n" + filled(full("BSD-3-Clause").replace("the copyright holder nor", "Contoso Ltd. nor")), "BSD-3-Clause"),
    ("\n".join(["MIT License"] * 40), None),
    # Not the whole licence, or more than it.
    ("MIT License\n\n" + MIT.replace("free of charge", "for a fee"), None),
    ("MIT License\n\nCopyright (c) Contoso Ltd.\n", None),
    ("We like the MIT License\n\n" + MIT, None),
    (full("GPL-3.0")[:9000], None),
    (APACHE.replace("irrevocable", "revocable"), None),
]


def test_sql_knows_the_same_texts(spark, found):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(CASES))), "text": [t for t, _ in CASES]}))
    made = con.sql(f"SELECT doc_id, license, digest FROM ({queries.OP5_SQL})").fetchall()
    assert {i: x for i, x, _ in made} == found


def test_equal_digests_take_the_least_name(spark):
    same = {"B": MIT, "A": MIT, "C": ISC}
    table = license_scan.known(spark, same, {"Z": ("One notice.",), "Y": ("One  notice",)})
    docs = spark.createDataFrame([(1, MIT), (2, "One notice")], "doc_id long, text string")
    assert {r.doc_id: (r.license, r.notices) for r in license_scan.scan(docs, table).collect()} == {1: ("A", []), 2: (None, ["Y"])}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: r.license for r in license_scan.scan(docs).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_whole_licences_are_found_in_their_usual_layouts(found, case):
    assert found[case] == CASES[case][1]
