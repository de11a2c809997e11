import numpy as np
import pytest

from folioworks.plans import adapters, recognize
from folioworks.sources import model


def test_round_trip_in_both_byte_orders():
    tiny = adapters.tiny_model()
    for swap in (False, True):
        got = model.load_model(adapters.model_bytes(tiny, swap))
        assert got.codes == tiny.codes and got.graphs == tiny.graphs and got.charset == tiny.charset
        assert all(got.checks().values())


def test_container_edges():
    c = model.parse_container(model.build_container({17: b"abc", 23: b"v1\n\0"}))
    assert c.present == [17, 23] and c.entries[17] == b"abc" and c.version == "v1" and not c.swapped
    assert model.parse_container(model.build_container({17: b"x"}, True)).swapped
    assert model.type_name(99) == "type(99)"
    with pytest.raises(ValueError):
        model.parse_container(b"\1\0\0\0" + (999).to_bytes(8, "little"))
    with pytest.raises(ValueError):
        model.parse_container(b"\1\0")


def test_charset_lines():
    got = model.parse_charset("2\nNULL 0 Common 0\né 3 0,255,0,255 Latin 5 0 4 e\t# x\nextra".encode())
    assert got[0].text == " " and got[0].normed == " " and got[1] == model.Character("é", "e", "Latin", 3)
    for bad in (b"", b"0\n", b"2\nx 1 Latin\n", b"1\nx 1\n"):
        with pytest.raises(ValueError):
            model.parse_charset(bad)


def test_recoder():
    codes = model.parse_recoder(model.build_recoder([[0], [5], [5]]))
    m = model.Model(adapters.tiny_model().network, [], codes, {})
    assert m.decoder[(5,)] == 2 and m.code_range == 6
    with pytest.raises(ValueError):
        model.parse_recoder(model.build_recoder([[1]]))
    with pytest.raises(ValueError):
        model.parse_recoder(model.build_recoder([[0]]) + b"\0")


def test_bad_networks():
    tiny = adapters.tiny_model()
    data = model.build_network(tiny.network)
    with pytest.raises(ValueError):
        model.parse_network(data + b"\0")
    tiny.network.root.num_weights += 1
    with pytest.raises(ValueError):
        model.parse_network(model.build_network(tiny.network))


def test_bytes_reversed():
    assert model.reversed_bytes(b"\1\2\3\4\5\6\7\x08", 4) == b"\4\3\2\1\x08\7\6\5"


def test_normalise():
    from folioworks.functions import tensor

    image = np.full((36, 40), 128, np.uint8)
    x, scale = recognize.normalise(image, 36, 3, tensor.Fill(1))
    assert scale == 3 and np.all(x == (np.float32(128) - np.float32(1)) / np.float32(127.5) - np.float32(1))
    assert recognize.normalise(np.full((72, 40), 9, np.uint8), 36, 3, tensor.Fill(1))[1] == 6
    for h, w in ((36, 2), (72, 5)):
        with pytest.raises(ValueError):
            recognize.normalise(np.full((h, w), 9, np.uint8), 36, 3, tensor.Fill(1))


def test_results_do_not_depend_on_order():
    r = recognize.Recognizer.of(adapters.tiny_model())
    a, b = (np.random.RandomState(s).randint(0, 256, (24, 90)).astype(np.uint8) for s in (1, 2))
    alone = r.recognize(b)
    r.recognize(a)
    assert r.recognize(b) == alone
    assert recognize.assemble([], 5, [], 1.0, (0, 0, 1, 1)) == {"text": "", "confidence": 0.0, "words": []}


def test_report_holds_every_section():
    tiny = adapters.tiny_model()
    text = model.describe(adapters.model_bytes(tiny, True))
    assert text[1] == "bytes swapped True" and "  lstm-word-dawg 194 bytes" not in text
    assert any(x.startswith("  2 [7] BLANK") for x in text) and f"charset {adapters.TINY_SIZE}" in text and "  lstm-number-dawg absent" in text
    assert any(x.startswith("  lstm-word-dawg ") and x.endswith(f"edges of {adapters.TINY_SIZE} characters") for x in text)
    assert model.describe(model.build_container({1: b"0", 23: b"old"})) == ["version old", "bytes swapped False", "components 2", "  unicharset 1", "  version 3", "no network"]


def test_files_source(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(adapters.model_bytes(adapters.tiny_model()))
    rows = model.read_components(spark, str(tmp_path)).select("type", "name", "size").orderBy("type").collect()
    assert [r.name for r in rows] == ["lstm", "lstm-punc-dawg", "lstm-word-dawg", "lstm-unicharset", "lstm-recoder", "version"]


def test_stream_equals_batch(spark, tmp_path):
    from folioworks.sources import images
    from folioworks.streaming import lines as stream

    r = recognize.Recognizer.of(adapters.tiny_model())
    rows = images.dense_images(adapters.pixels(spark, "/root/testdata/sf0.001"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream.recognize_stream(stream.read_lines(spark, str(tmp_path / "in"), 1), r, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {x.line_id: x.text for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {x.line_id: x.text for x in recognize.recognize_lines(rows, r).collect()} and len(got) == 8
