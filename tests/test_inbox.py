"""Files that arrive are checked once for each content and parameters; what fails is a row."""

import json
import os
import zipfile

import pytest

from tesserae.operators import store
from tesserae.streaming import inbox, tasks

TEXT = ["The survey covers nine villages in the northern valley!", "Each household answered the same list of questions twice."]
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(path, *lines):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    made = store.SentenceStore(spark, str(tmp_path_factory.mktemp("lib") / "store"))
    made.append(spark.createDataFrame([("source.txt", "\n".join(TEXT))], "name string, text string"))
    return made


def answers(own):
    return {os.path.basename(r["path"]): r for r in own.answers().collect()}


def test_a_content_is_checked_once(spark, tmp_path, kept):
    box, root, state = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "state")
    box.mkdir()
    own = inbox.Inbox(kept, root)
    docx(box / "one.docx", TEXT[0], "Nothing else in here was ever printed before in any book.")
    docx(box / "two.docx", TEXT[0], "Nothing else in here was ever printed before in any book.")
    (box / "bad.docx").write_bytes(b"no zip file")
    (box / "empty.txt").write_text("\n")  # Spark leaves files of no byte alone
    (box / "~tmp.txt").write_text("skipped")
    (box / "image.png").write_bytes(b"skipped")
    own.watch(str(box), state).awaitTermination(300)
    got = answers(own)
    assert set(got) == {"one.docx", "two.docx", "bad.docx", "empty.txt"}
    assert got["one.docx"]["report_no"] == got["two.docx"]["report_no"] and 0.3 < got["one.docx"]["total_ratio"] < 0.7
    assert got["bad.docx"]["error"] and got["bad.docx"]["report_no"] is None and got["empty.txt"]["total_ratio"] == 0
    assert own.reports().count() == 2 and not got["one.docx"]["cached"]
    page = tmp_path / "out/files/查重报告__one.html"
    said = json.loads((tmp_path / "out/files/查重摘要__one.json").read_text())
    assert "nine villages" in page.read_text() and said["sources"][0]["name"] == "source.txt" and said["params_key"] == kept.params_key()

    docx(box / "three.docx", TEXT[0], "Nothing else in here was ever printed before in any book.")  # known: answered from the report
    own.watch(str(box), state).awaitTermination(300)
    got = answers(own)
    assert got["three.docx"]["cached"] and got["three.docx"]["report_no"] == got["one.docx"]["report_no"] and own.reports().count() == 2

    page.unlink()  # its report is gone: checked again
    docx(box / "four.docx", TEXT[0], "Nothing else in here was ever printed before in any book.")
    own.watch(str(box), state).awaitTermination(300)
    assert answers(own)["four.docx"]["cached"] is False and own.reports().count() == 2
    assert (tmp_path / "out/files/查重报告__four.html").exists()

    other = inbox.Inbox(kept, root, fallback=False)  # other parameters check it again
    docx(box / "five.docx", TEXT[0], "Nothing else in here was ever printed before in any book.")
    other.watch(str(box), state).awaitTermination(300)
    assert answers(own)["five.docx"]["cached"] is False and own.reports().count() == 3

    states = [r["status"] for r in tasks.current(tasks.changes(own.events())).collect()]
    assert sorted(states) == ["done"] * 6 + ["error"]


def test_a_repeated_batch_changes_nothing(spark, tmp_path, kept):
    (tmp_path / "box").mkdir()
    (tmp_path / "box/a.txt").write_text("\n".join(TEXT))
    own = inbox.Inbox(kept, str(tmp_path / "out"), fallback=False)
    batch = spark.read.format("binaryFile").load(str(tmp_path / "box"))
    for _ in range(2):
        own.handle(batch, 0)
        assert own.reports().count() == own.answers().count() == 1 and own.events().count() == 3
    assert own.answers().first()["total_ratio"] == 1.0
