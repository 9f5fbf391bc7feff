import pytest

from rhetorica.operators import transcripts as tr
from rhetorica.sources import corpus

RAW = "Opening words\nANNA: Good evening. We start\nnow.\n[BO]: Thank you! [applause]\nANNA ::\nSecond turn\n\nCARL -: No.\n"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("a.txt", RAW), ("b.txt", "no label here"), ("c.txt", None), ("d.txt", "")], "file_id string, raw string")


def test_labels_and_utterances(spark, files):
    assert {r.label for r in tr.raw_labels(files).collect()} == {"ANNA:", "[BO]:", "ANNA ::", "CARL -:"}
    assert {r.speaker for r in tr.speakers(files).collect()} == {"ANNA", "BO", "CARL -"}
    got = [(r.utt_id, r.speaker, r.text) for r in tr.utterances(files).orderBy("utt_id").collect()]
    assert got == [(1, "ANNA", " Good evening. We start\nnow.\n"), (2, "BO", " Thank you! [applause]\n"), (3, "ANNA", "\nSecond turn\n\n"), (4, "CARL -", " No.\n")]


def test_filter_and_match(spark, files):
    assert tr.utterances(files, "bo").count() == 1
    assert tr.utterances(files, ["[Anna]:"]).count() == 2
    assert tr.matching(tr.utterances(files), ["CARL"]).count() == 1
    with pytest.raises(TypeError):
        tr.utterances(files, 7)


def test_words_and_sentences(spark, files):
    utts = tr.utterances(files)
    assert [r.token for r in tr.words(utts).where("utt_id = 2").orderBy("pos").collect()] == ["Thank", "you", "!", "[", "applause", "]"]
    assert [r.tokens for r in tr.sentences(utts).where("utt_id = 1").orderBy("sent_id").collect()] == [["Good", "evening", "."], ["We", "start", "now", "."]]
    grouped = {r.speaker: r.text for r in tr.grouped_text(utts).collect()}
    assert grouped["ANNA"] == " Good evening. We start\nnow.\n\nSecond turn\n\n"
    assert tr.grouped_sentences(utts).where("speaker = 'ANNA'").count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text(RAW)
    (tmp_path / "in" / "sub" / "b.txt").write_text("BO: été\n")
    (tmp_path / "in" / "c.md").write_text("x")
    root = str(tmp_path / "in")
    assert corpus.scan(spark, root, "txt").count() == 2
    assert {r.file_id: r.raw for r in corpus.transcripts(spark, root).collect()} == {"a.txt": RAW, "sub/b.txt": "BO: été\n"}
    assert corpus.transcripts(spark, root, r"sub/.*").count() == 1


def test_processed_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("ANNA", 2, [["<S>", "a", "</S>"], []]), ("BO", None, None)], corpus.PROCESSED_SCHEMA)
    corpus.write_processed(df, str(tmp_path / "p"))
    assert sorted(map(tuple, corpus.read_processed(spark, str(tmp_path / "p")).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    lines = spark.createDataFrame([(1, "a\nb", "X"), (2, "", None)], "row_id bigint, text string, label string")
    corpus.write_lines(lines, str(tmp_path / "l"))
    assert sorted(map(tuple, corpus.read_lines(spark, str(tmp_path / "l")).collect())) == [(1, "a\nb", "X"), (2, "", None)]


def test_aligned_lines(spark, tmp_path):
    (tmp_path / "t").write_text("one\ntwo\n")
    (tmp_path / "l").write_text("X\nY\n")
    assert sorted(map(tuple, corpus.read_aligned(spark, str(tmp_path / "t"), str(tmp_path / "l")).collect())) == [(0, "one", "X"), (1, "two", "Y")]
    (tmp_path / "m").write_text("X\n")
    with pytest.raises(Exception, match="different numbers"):
        corpus.read_aligned(spark, str(tmp_path / "t"), str(tmp_path / "m")).collect()
