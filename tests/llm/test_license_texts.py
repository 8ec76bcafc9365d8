"""Whole licence texts, as files and inside documents."""

import re

from helixweave.llm import license_scan

MIT = license_scan.KNOWN[9][1]


def wrapped(text, n=9, mark=""):
    words = text.split()
    return "\n".join(mark + " ".join(words[k : k + n]) for k in range(0, len(words), n))


def test_standard_files(spark):
    own = dict(license_scan.texts())
    bsd = re.sub("the University", "Acme Inc.", re.sub("REGENTS", "COPYRIGHT HOLDERS", own["BSD-3-Clause"]))
    apache = own["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 Acme")
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Me\n\n" + MIT, "MIT", "MIT"), (2, "BSD 3-Clause License\n\nCopyright (c) 2020, Me\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause", "BSD-3-Clause,all-rights-reserved"),
        (3, apache, "Apache-2.0", "Apache-2.0"), (4, "#!/bin/sh\n" + wrapped(MIT, mark="# ") + "\nexit 0", None, "MIT"), (5, "some words " + wrapped(own["GPL-2.0"], 13) + " and more", None, "GPL-2.0"),
        (6, wrapped(MIT)[:-9], None, ""), (7, None, None, ""), (8, wrapped(MIT) + "\n--\n" + own["Unlicense"], None, "MIT,Unlicense"),
    ]
    got = {r.doc_id: (r.whole_license, r.licenses) for r in license_scan.license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, text, whole, found in rows:
        assert got[i][0] == whole and set(found.split(",")) <= set(got[i][1].split(",")), (i, got[i])
        if i in (1, 2, 4, 6, 7):
            assert got[i][1] == found


def test_each_text_is_found(spark):
    rows = [(k, t) for k, (_, t) in enumerate(license_scan.texts())]
    got = {r.doc_id: r.whole_license for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: i for k, (i, _) in enumerate(license_scan.texts())}


def test_ids_named_id(spark):
    rows = spark.createDataFrame([(1, "released under the MIT license"), (None, "x"), (2, None)], "id long, text string").selectExpr("*", "'a' as license", "'b' as digest", "'c' as asked")
    assert {r.id: r.licenses for r in license_scan.license_scan(rows, id_col="id").collect()} == {1: "MIT", None: "", 2: ""}
    assert license_scan.license_scan(rows.where("false"), id_col="id").count() == 0
