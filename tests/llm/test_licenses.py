import hashlib

from pyspark.sql import functions as F

from pagelumen.llm import licenses
from tests.llm.fixtures import docs


def test_canonical_forms_meet(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [
        None,
        "",
        mit,
        mit.upper().replace("\n\n", "\n\nCopyright (c) 2021 Somebody Else\n\n").replace("SUBLICENSE", "sub-licence"),
        mit.replace("granted", "refused"),
        "Released under the MIT licence!",
        "\u00a9 1999 A. Author\nLicensed under CC BY-NC 4.0\n",
        mit + " x",
        mit,
    ]
    out = {r.doc_id: r for r in licenses.scan(docs(spark, texts, "license_id")).collect()}
    assert [out[i].license_id for i in range(len(texts))] == [None, None, "MIT", "MIT", None, "MIT-line", "CC-BY-NC-4.0-line", None, "MIT"]
    assert out[0].digest is None
    for i, t in enumerate(texts):
        if t is not None:
            assert out[i].digest == hashlib.sha256(licenses.canonical_text(t).encode()).hexdigest()
    assert licenses.scan(docs(spark, ["a"]).limit(0)).count() == 0


def test_other_columns_play_no_part(spark):
    texts = [licenses.KNOWN["MIT"], None, "other"]
    plain = docs(spark, texts)
    clashing = plain.withColumns({"digest": F.lit("x"), "license_id": F.lit("y"), "Digest2": F.lit(1)})
    wanted, found = ({tuple(r) for r in licenses.scan(d).collect()} for d in (plain, clashing))
    assert found == wanted and len(found) == 3


def test_known_texts_are_distinct():
    digests = [d for _, d in licenses.known_digests()]
    assert len(set(digests)) == len(licenses.KNOWN)


def test_whole_licences_and_titles_are_known(spark):
    mit, isc, bsd = (licenses.KNOWN[k] for k in ("MIT", "ISC", "BSD-2-Clause"))
    gpl, apache = (licenses.KNOWN[f"{k}|text"] for k in ("GPL-2.0", "Apache-2.0"))
    end = "END OF TERMS AND CONDITIONS"
    wanted = [
        (mit.removeprefix("MIT License"), "MIT"),
        ("The MIT License (MIT)\n\nCopyright (c) 2020 A. Author\n" + mit.removeprefix("MIT License"), "MIT"),
        (isc.removeprefix("ISC License"), "ISC"),
        ("BSD 2-Clause License\n\nCopyright (c) 2020, A. Author\nAll rights reserved.\n\n" + bsd, "BSD-2-Clause"),
        (licenses.KNOWN["BSD-3-Clause"], "BSD-3-Clause"),
        (gpl, "GPL-2.0"),
        (gpl.split(end)[0], "GPL-2.0"),
        (apache.split(end)[0] + end, "Apache-2.0"),
        (apache.replace("[yyyy] [name of copyright owner]", "2020 A. Author"), "Apache-2.0"),
    ]
    wanted += [(text, name.split("|")[0]) for name, text in licenses.KNOWN.items()]
    out = {r.doc_id: r.license_id for r in licenses.scan(docs(spark, [t for t, _ in wanted])).collect()}
    assert [out[i] for i in range(len(wanted))] == [name for _, name in wanted]
    assert {"GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(out.values())
