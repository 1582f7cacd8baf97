"""Licence texts wrapped and titled in their usual forms."""

import os
import textwrap

import pytest

from velotrace.llm import license_scan

SHARED = "/usr/share/common-licenses"


def body(name):
    return next(text for n, text in license_scan.KNOWN if n == name and "\n" in text)


def found(spark, texts, known=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["license_id"] for r in license_scan.scan(rows, known=known).orderBy("doc_id").collect()]


def test_wrapped_anywhere(spark):
    """Some width puts each word of a body at a line's start; the notice of the standard ISC text is one of them."""
    names = ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause")
    isc = body("ISC").replace(" copyright notice and", "\ncopyright notice and", 1)
    assert "\ncopyright notice and this" in isc and license_scan.digest(isc) == license_scan.digest(body("ISC"))
    for name in names:
        for width in range(20, 90):
            wrapped = "\n".join(textwrap.fill(line, width) for line in body(name).splitlines())
            assert license_scan.digest(wrapped) == license_scan.digest(body(name)), (name, width)


def test_titles_and_statements(spark):
    heads = [("MIT", "MIT License\n\nCopyright (c) 2021 Some Body\n\n"), ("ISC", "ISC License\n\nCopyright 2020, Some Body <a@b.c>\n\n"), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright Some Body\nAll rights reserved.\n\n")]
    wrapped = [head + textwrap.fill(body(name), 79, replace_whitespace=False) for name, head in heads]
    assert found(spark, wrapped) == [name for name, _ in heads]
    bullets = body("BSD-2-Clause").replace("1. ", "* ").replace("2. ", "* ")
    assert found(spark, [bullets, "ISC License\n" + body("MIT"), "MIT License"]) == ["BSD-2-Clause", None, None]
    for clause in ("(c) You must retain, in the Source form", '"Copyright" also means copyright-like laws', "copyright holders be liable"):
        assert license_scan.canonical(clause)
    for statement in ("(c) 2020 Some Body", "© Some Body", "Copyright (C) <year> <name>", "Copyright [yyyy] [name]", "Copyright The Authors"):
        assert not license_scan.canonical(statement)


def test_known_texts_from_a_table(spark):
    rows = [("Own-1.0", "You may read this.\nYou may not copy it."), ("Own-1.0", "Under the Own Licence."), ("None", None)]
    table = spark.createDataFrame(rows, "license_id string, text string")
    docs = spark.createDataFrame([(1, "you may read this you may\nnot copy it"), (2, "x\nUnder the Own License")], "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in license_scan.scan(docs, known=table).collect()}
    assert got == {1: ("Own-1.0", []), 2: (None, ["Own-1.0"])}


@pytest.mark.skipif(not os.path.isdir(SHARED), reason="the long texts are not installed")
def test_long_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    texts = [open(f"{SHARED}/{f}", encoding="utf-8").read() for f in names]
    paragraphs = ["\n".join(textwrap.fill(p, 60) if "opyright (C)" not in p and "opyright [" not in p else p for p in t.split("\n\n")) for t in texts]
    assert found(spark, texts + paragraphs) == [*names.values()] * 2
