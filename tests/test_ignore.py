from __future__ import annotations

from lodeseek.sources.corpora import ignore_patterns


def test_ignore_file_is_read_whole(spark, tmp_path):
    path = tmp_path / "ignore.txt"
    path.write_text("# comment\n\n" + "".join(f"  dir{k}/**\n" for k in range(10_050)))
    got = ignore_patterns(spark, str(path))
    assert len(got) == 10_050 and got[-1] == "dir10049/**"
