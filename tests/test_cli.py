"""The command line over a small folder."""

from lexspark.cli import main
from lexspark.sources import token_file, vocab_file


def test_cli(spark, tmp_path, capsys):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("the cat and the dog and the bird and the thing " * 20)
    c, t, v, y = (str(tmp_path / n) for n in ("c.tok", "t.tok", "v.vocab", "v.yaml"))
    assert main(["mine", "--input", str(src), "--output", c, "--min-occur", "5", "--max-length", "8"]) == 0
    assert main(["train", "--input", str(src), "--tokens", c, "--size", "150", "--output", t, "--folder", str(tmp_path / "rounds")]) == 0
    assert main(["export", "--tokens", t, "--vocab", v, "--yaml", y, "--add-special", "<s>"]) == 0
    assert main(["bench", "--vocab", v, "--input", str(src)]) == 0
    assert main(["compare", c, t]) == 0 and main(["merge", c, t, "--output", str(tmp_path / "m.tok")]) == 0
    with open(v, "rb") as f:
        assert vocab_file.loads(f.read()).counts()["special"] == 1
    assert token_file.loads((tmp_path / "m.tok").read_bytes()).tokens
    assert "MB/s" in capsys.readouterr().out
