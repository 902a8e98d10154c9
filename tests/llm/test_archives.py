import textwrap

import pytest
from pyspark.sql import functions as F

from gridspark.llm.licenses import APACHE, BSD, BSD_NAMES, DISCLAIMER, ISC, folders, scan
from gridspark.llm.warc import audit, leaves_by, manifest, read_warc, records, tree, write_warc

PAGES = "page_id long, url string, html string, length string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>\r\n\r\nWARC/1.0 é" * (i % 5), "x") for i in range(700)]
    rows += [(3, "again", "repeated id", None), (3, "again", "repeated id", None), (None, None, None, None)]
    return spark.createDataFrame(rows, PAGES).repartition(6).persist()


def test_equal_replicas_have_no_faults(pages):
    ours = manifest(records(pages))
    assert audit(ours, leaves_by(records(pages), ours)).collect() == []


def test_faults_are_located(pages):
    ours = manifest(records(pages))
    html = F.when(F.col("page_id") == 77, F.lit("changed")).when(F.col("url") == "again", F.lit("repeated iD")).otherwise(F.col("html"))
    second = records(pages.withColumn("html", html)).where(~F.coalesce(F.col("page_id") == 500, F.lit(False)))
    faults = audit(ours, leaves_by(second, ours)).collect()
    assert sorted((r.page_id, r.fault) for r in faults) == [(3, "altered"), (3, "altered"), (77, "altered"), (500, "missing")]
    lost = audit(leaves_by(second, ours), ours).collect()
    assert {r.page_id for r in lost if r.fault == "extra"} == {500}


def test_partitions_do_not_matter_and_added_records_are_found(pages):
    ours = manifest(records(pages))
    assert audit(ours, leaves_by(records(pages.repartition(5, "url")), ours)).collect() == []
    more = pages.where("page_id in (40, 77)").withColumn("html", F.lit("new"))
    other = pages.where("page_id = 500").withColumn("page_id", F.lit(100_000))
    second = records(pages.unionByName(more).unionByName(other).repartition(3))
    faults = audit(ours, leaves_by(second, ours)).orderBy("pos").collect()
    n, stop = ours.count(), ours.agg(F.sum("length")).first()[0]
    assert [(r.page_id, r.fault, r.pos) for r in faults] == [(40, "extra", n), (77, "extra", n + 1), (100_000, "extra", n + 2)]
    assert [r.offset for r in faults] == [stop, stop + faults[0].found_length, stop + faults[0].found_length + faults[1].found_length]
    changed = F.when(F.col("url") == "again", F.concat(F.col("html"), F.lit("!"))).otherwise(F.col("html"))
    again = records(pages.withColumn("html", changed).repartition(4))
    assert {(r.page_id, r.fault) for r in audit(ours, leaves_by(again, ours)).collect()} == {(3, "altered")}
    none = ours.where("false")
    assert {r.fault for r in audit(none, leaves_by(records(pages), none)).collect()} == {"extra"}


def test_manifest_is_gapless(pages):
    rows = manifest(records(pages)).orderBy("pos").collect()
    at = 0
    for k, r in enumerate(rows):
        assert r.pos == k and r.offset == at
        at += r.length
    assert rows[0].page_id is None and len(rows) == 703


def test_root_covers_everything(pages):
    ours = manifest(records(pages))
    root = tree(ours, 3)[-1].collect()
    assert len(root) == 1 and (root[0].offset, root[0].stop) == (0, ours.agg(F.sum("length")).first()[0])


def test_empty_and_single_archives(spark, pages):
    none = manifest(records(pages.where("page_id = -1")))
    assert audit(none, none).collect() == []
    one = manifest(records(pages.where("page_id = 5")))
    assert audit(one, one).collect() == [] and [r.fault for r in audit(one, none).collect()] == ["missing"]


def test_warc_files_round_trip(spark, pages, tmp_path):
    write_warc(pages, f"{tmp_path}/warc")
    back = read_warc(spark, f"{tmp_path}/warc").collect()
    as_rows = lambda rows: sorted((str(r.page_id), r.url or "", r.html or "") for r in rows)
    assert as_rows(back) == as_rows(pages.collect())
    files = {}
    for r in back:
        files.setdefault(r.file, []).append((r.offset, r.length))
    for places in files.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length


def test_folders(spark):
    row = spark.sql("select 'a/b/c.txt' p, 'x' q, cast(null as string) n").select(folders(F.col("p")), folders(F.col("q")), folders(F.col("n"))).first()
    assert tuple(row) == (["", "a", "a/b"], [""], None)


def test_scan_of_a_repository(spark):
    rows = [
        (1, "r/LICENSE", "The MIT License (MIT)\n\nCopyright (c) somebody"),
        (2, "r/a.txt", "no notice"),
        (3, "r/s/t/b.txt", None),
        (4, "r/s/COPYING", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
        (5, "r/s/c.txt", "Licensed under the Apache License, Version 2.0."),
        (6, "r/s/t/d.txt", "plain"),
        (7, "other/e.txt", "plain"),
        (8, None, "Released under the MIT License."),
        (9, None, "plain"),
        (6, "r/s/t/d.txt", "plain"),
        (10, "rs/f.txt", "this license is nothing we know of, at all"),
        (11, "LICENSE.md", ""),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, path string, text string, notice string")
    got = sorted((r.doc_id, r.license, r.origin) for r in scan(df).collect())
    assert got == sorted(
        [
            (1, "MIT", "header"), (2, "MIT", "directory"), (3, "GPL-3.0", "directory"), (4, "GPL-3.0", "header"), (5, "Apache-2.0", "header"),
            (6, "GPL-3.0", "directory"), (6, "GPL-3.0", "directory"), (7, None, None), (8, "MIT", "header"), (9, None, None), (10, None, None), (11, None, None),
        ],
        key=lambda r: (r[0], r[1], r[2]),
    )


def test_root_licence_reaches_everything(spark):
    df = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c", "x"), (3, "d", "y")], "doc_id long, path string, text string")
    assert {r.license for r in scan(df).collect()} == {"MIT"}


def test_scan_without_notices_or_rows(spark):
    df = spark.createDataFrame([(1, "a/b", "plain")], "doc_id long, path string, text string")
    assert [(r.license, r.origin) for r in scan(df).collect()] == [(None, None)] and scan(df.where("false")).collect() == []


MIT_BODY = """Copyright (c) 2019 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def gnu_header(mark, name, version):
    return (
        f"{mark} frob.c - frobs things\n{mark}\n{mark} This program is free software; you can redistribute it and/or modify\n"
        f"{mark} it under the terms of the GNU {name} as published by\n{mark} the Free Software Foundation; either version {version} of the License, or\n"
        f"{mark} (at your option) any later version.\n{mark}\n{mark} This program is distributed in the hope that it will be useful,\n"
        f"{mark} but WITHOUT ANY WARRANTY; without even the implied warranty of\n{mark} MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.\n\nint main() {{ return 0; }}\n"
    )


def bsd(wrap, names):
    text = BSD + (BSD_NAMES if names else "") + DISCLAIMER
    lines = textwrap.wrap(text, wrap)
    return "/*\n * Copyright 2001 The Holders. All rights reserved.\n" + "".join(f" * {line}\n" for line in lines) + " */\n\nint x;\n"


def test_wrapped_headers_and_whole_texts(spark):
    """Notices that no single line tells: wrapped headers under comment marks, titles over two lines, bodies of several paragraphs."""
    prose = "words of a story that has no end and goes on and on\n" * 40
    rows = [
        (1, "a/x.c", gnu_header(" *", "General Public License", "3"), "GPL-3.0"),
        (2, "a/y.sh", gnu_header("#", "General Public License", "2"), "GPL-2.0"),
        (3, "a/z.py", gnu_header("//", "Affero General Public License", "3"), "AGPL-3.0"),
        (4, "a/l.c", gnu_header("--", "Lesser General Public License", "2.1"), "LGPL-2.1"),
        (5, "b/LICENSE", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + prose, "GPL-3.0"),
        (6, "c/COPYING", "\tGNU GENERAL PUBLIC LICENSE\n\t   Version 2, June 1991\n\n" + prose, "GPL-2.0"),
        (7, "d/LICENSE.txt", MIT_BODY, "MIT"),
        (8, "e/f.c", bsd(60, True), "BSD-3-Clause"),
        (9, "e/g.c", bsd(72, False), "BSD-2-Clause"),
        (10, "h/LICENSE", "\n\n".join(textwrap.wrap(ISC, 50)), "ISC"),
        (11, "i/f.go", "// " + "\n// ".join(textwrap.wrap(APACHE, 70)) + "\npackage i\n", "Apache-2.0"),
        (12, "j/f.txt", prose + "Released under the MIT License.\n" + prose, "MIT"),
        (13, "k/f.txt", prose + "the warranty of a story is no license, nor is its permission\n" + prose, None),
        (14, "d/deep/er/f.txt", prose, "MIT"),
        (15, "l/LICENSE", None, None),
        (16, "l/f.txt", "license " * 30_000, None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")
    assert {r.doc_id: r.license for r in scan(df).collect()} == {r[0]: r[3] for r in rows}


def test_equal_scores_give_the_first_license(spark):
    df = spark.createDataFrame([(1, "a/f", "Released under the MIT License\nReleased under the ISC License")], "doc_id long, path string, text string")
    assert [r.license for r in scan(df).collect()] == ["ISC"]
