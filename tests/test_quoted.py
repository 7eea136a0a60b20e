"""Documents with quotes, marks and bad bytes."""

from casewright.sources import quoted


def test_csv_documents(spark):
    files = [
        (1, "﻿name,note\r\n\"Patil, Asha\",\"said \"\"no\"\"\nand left\"\r\n\r\nRavi\r\na,b,c\n".encode()), (2, b"name\n\xff\xfe"), (3, b""), (4, b" , \n1,2"), (5, None), (6, b"a\n" + b"x\n" * 7), (7, b"a\n" + b"y" * 900),
    ]
    got = quoted.csv_documents(spark.createDataFrame(files, "id long, content binary"), "id", "content", most=5).collect()
    by = {(r.id, r.row_no): r for r in got}
    assert len(by) == len(got)
    assert by[1, 1].cells == {"name": "Patil, Asha", "note": 'said "no"\nand left'} and by[1, 2].cells == {"name": "Ravi", "note": ""} and by[1, 3].cells == {"name": "a", "note": "b"}
    assert {k: (by[k, 0].problem, by[k, 0].left_out) for k in range(1, 8)} == {1: (None, 0), 2: ("not valid UTF-8", 0), 3: ("no header row", 0), 4: ("no header row", 0), 5: ("no header row", 0), 6: (None, 2), 7: (None, 0)}
    assert max(n for k, n in by if k == 6) == 5 and len(by[7, 1].cells["a"]) == 500


def test_text_documents(spark):
    files = spark.createDataFrame([(1, b"a\r\nb\n\nc"), (2, b"\xff"), (3, b"")], "id long, content binary")
    got = sorted(((r.id, r.line_no, r.line, r.problem) for r in quoted.text_documents(files, "id", "content").collect()), key=str)
    assert got == sorted([(1, 1, "a", None), (1, 2, "b", None), (1, 3, "", None), (1, 4, "c", None), (2, None, None, "not valid UTF-8"), (3, 1, "", None)], key=str)
