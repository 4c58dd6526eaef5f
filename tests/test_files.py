"""Separators and encodings of raw files."""

import io
from contextlib import redirect_stdout

from lumenframe.sources import files as fl


def test_separators_of_odd_lines(spark, tmp_path):
    """Quoted separators and bytes that are no UTF-8 do not count."""
    for name, lines in {"a": [b'x;"1;2";y', b'\xe9;"";\xff', b'1;"a,b,c";2', b""], "b": [b"1|2|3", b'"|"|x|\xc3', b"a|b|c"],
                        "c": [b"1\t2", b"\xe9\t3"], "d": [b"none", b"at all"], "e": [b"1,2", b'"3,4",5']}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.csv").write_bytes(b"\n".join(lines) + b"\n")
    found = {r["path"]: r["separator"] for r in fl.detect_separators(spark, str(tmp_path), fl.folder).collect()}
    assert found == {"a": ";", "b": "|", "c": "\t", "d": ",", "e": ","}
    kinds = {r["path"]: r["encoding"] for r in fl.detect_encodings(spark, str(tmp_path), fl.folder).collect()}
    assert kinds == {"a": "latin-1", "b": "latin-1", "c": "latin-1", "d": "utf-8", "e": "utf-8"}


def test_lines_meet_no_pattern_per_separator(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.csv").write_bytes(b"1,2\n")
    with redirect_stdout(io.StringIO()) as out:
        fl.detect_separators(spark, str(tmp_path), fl.folder).explain("extended")
    plan = out.getvalue()
    assert "octet_length" in plan and "regexp_extract_all" not in plan and "regexp_count" not in plan
