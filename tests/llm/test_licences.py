import os

import pytest

from vigilflow.llm.licence_texts import APACHE_NOTICE, DIGESTS, GPL_NOTICE, ISC, KNOWN, MIT, MPL_NOTICE, NOTICES
from vigilflow.llm.licences import scan


def test_whole_texts_and_lines(spark):
    shouted = "Copyright (c) 1999 Somebody\n\n" + MIT.upper().replace("\n", "\r\n").replace('"', "''").replace("LICENSE", "LICENCE")
    commented = "\n".join("# " + line for line in ISC.split("\n"))
    rows = [
        (1, shouted), (2, commented), (3, MIT + "\nand more"), (4, "text\nReleased under the MIT License.\nreleased under the mit licence"),
        (5, "Licensed under the Apache Licence, Version 2.0."), (6, None), (7, ""), (8, "All rights reserved."), (5, "nothing"),
        (None, "SPDX-License-Identifier: MIT"), (9, "x " * 200_000),
    ]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, licence string")
    got = {(r["doc_id"], r["scope"], r["licence"]): r["n"] for r in scan(frame).collect()}
    assert got == {
        (1, "text", "MIT"): 1, (2, "text", "ISC"): 1, (4, "line", "MIT"): 2, (5, "text", "Apache-2.0"): 1, (5, "line", "Apache-2.0"): 1,
        (None, "text", "MIT"): 1, (None, "line", "MIT"): 1,
    }
    assert scan(frame.limit(0)).collect() == []


def test_every_known_text_finds_itself(spark):
    frame = spark.createDataFrame([(i, body) for i, (_, body) in enumerate(KNOWN)], "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in scan(frame).where("scope = 'text'").collect()}
    assert got == {i: name for i, (name, _) in enumerate(KNOWN)}


COMMON = "/usr/share/common-licenses"
ENTIRE = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence files here")
def test_entire_licences(spark):
    rows, ends = [], "END OF TERMS AND CONDITIONS"
    for name, licence in ENTIRE.items():
        with open(f"{COMMON}/{name}", encoding="utf-8") as file:
            body = file.read()
        rows.append((licence, body))
        if ends in body:
            rows.append((licence, body[: body.index(ends) + len(ends)]))
    frame = spark.createDataFrame([(i, body) for i, (_, body) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in scan(frame).where("scope = 'text'").collect()}
    assert got == {i: licence for i, (licence, _) in enumerate(rows)}
    assert len({digest for _, digest in DIGESTS}) == len(DIGESTS)


def test_notices_within_documents(spark):
    commented = "\n".join("# " + line for line in APACHE_NOTICE.split("\n"))
    rows = [
        (1, commented + "\n\nimport os"), (2, f"{GPL_NOTICE}\n{GPL_NOTICE}\nx"), (3, "a " + " ".join(MPL_NOTICE.split()) + " b"),
        (4, "x" + APACHE_NOTICE), (5, APACHE_NOTICE[:-1] + "s"), (6, APACHE_NOTICE.replace("WARRANTIES", "warranty")), (7, None),
    ]
    rows += [(10 + i, f"head\n{body}\ntail") for i, (_, body) in enumerate(NOTICES)]
    got = {(r["doc_id"], r["scope"], r["licence"]): r["n"] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        (1, "notice", "Apache-2.0"): 1, (2, "notice", "GPL-3.0-or-later"): 2, (3, "notice", "MPL-2.0"): 1,
        **{(10 + i, "notice", name): 1 for i, (name, _) in enumerate(NOTICES)},
    }
