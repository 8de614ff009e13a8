"""Transcript files: columns by name."""

from __future__ import annotations

import pytest

from callweave.sources import transcripts as tr

HEAD = "Unnamed: 0,componenttext,year,speakertypeid,extra,doc_id,transcriptcreationdate_utc,componenttextpreview\n"


@pytest.mark.parametrize("line_breaks", [True, False])
def test_columns_are_found_by_name(spark, tmp_path, line_breaks):
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text(HEAD + f'{i},"a ""b"", c",2020,,x,{7 + i},2020-01-02 00:00:00,a\n')
    rows = sorted(tr.scan_transcripts(spark, str(tmp_path), line_breaks=line_breaks).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.year, r.speakertypeid, r.componenttext) for r in rows] == [(7, 2020, None, 'a "b", c'), (8, 2020, None, 'a "b", c')]


def test_missing_and_moved_columns_stop_the_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.csv").write_text("doc_id,year\n1,2020\n")
    with pytest.raises(ValueError, match="componenttext"):
        tr.scan_transcripts(spark, str(tmp_path / "a"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.csv").write_text(HEAD + "0,t,2020,1,x,7,d,p\n")
    moved = ",".join(reversed(HEAD.strip().split(",")))
    (tmp_path / "b/y.csv").write_text(moved + "\np,d,8,x,1,2020,t,0\n")
    with pytest.raises(Exception, match="(?i)header"):
        tr.scan_transcripts(spark, str(tmp_path / "b")).collect()
