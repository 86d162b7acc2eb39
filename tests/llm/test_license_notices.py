"""Labels of short notices, and of long ones that are wrapped."""

import textwrap

import pytest

from tests.llm.cases import docs
from tidegauge.llm import license_scan

LINES = {
    "Released under the MIT License.": "mit",
    "Licensed under the MIT license": "mit",
    "Distributed under the terms of the MIT License.": "mit",
    "SPDX-License-Identifier: MIT": "mit",
    "Licensed under the 3-clause BSD license.": "bsd",
    "Released under the BSD License": "bsd",
    "Licensed under the BSD 2-Clause License": "bsd",
    "Released under the ISC License.": "isc",
    "Licensed under the MPL 2.0.": "mpl-2.0",
    "Licensed under the Mozilla Public License, v. 2.0": "mpl-2.0",
    "Released under the Example License.": "",
}


def labels(spark, texts):
    return {r.doc_id: r.labels for r in license_scan.scan(docs(spark, texts)).collect()}


def test_short_notices(spark):
    got = labels(spark, list(LINES))
    assert {t: got[i] for i, t in enumerate(LINES)} == LINES


@pytest.mark.parametrize("width", [40, 72])
def test_wrapped_templates(spark, width):
    texts = ["Some code here.\n" + textwrap.indent(textwrap.fill(t, width), " * ") + "\nmore code" for _, t in license_scan.TEMPLATES]
    got = labels(spark, texts)
    for i, (label, _) in enumerate(license_scan.TEMPLATES):
        assert label in got[i].split(","), i


def test_whole_texts_from_a_table(spark):
    text = "Permission is granted to use the thing.\n\nThe thing comes without any promise, and nobody answers for what it does to you or your goods."
    table = spark.createDataFrame([("thing-1.0", text), ("thing-1.0", text), (None, "x"), ("empty", " ")], "label string, wording string")
    templates = license_scan.templates_of(table)
    assert templates == (("thing-1.0", text),)
    wrapped = "code\n" + textwrap.fill(text.upper(), 30) + "\nmore"
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs(spark, [wrapped, "Permission is granted to use the thing."]), templates).collect()}
    assert got == {0: ("thing-1.0", 1.0), 1: ("", 0.0)}
