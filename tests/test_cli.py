import json

import pytest
from test_recordings import DL

from causeway.__main__ import main
from causeway.sources.log_format import write_log


def test_reports(spark, tmp_path, capsys):
    import __spark_entry__

    __spark_entry__._session(spark)
    path = str(tmp_path / "a.log")
    write_log(path, DL, b"TEST")
    assert main(["why-blocked", path]) == 2
    got = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(g["task"], g["outcome"], g["chain"]) for g in got] == [(1, "deadlock", [1, 2])]
    assert main(["why-blocked", path, "--task", "t2", "--at", "10"]) == 0
    assert json.loads(capsys.readouterr().out)["outcome"] == "not_blocked"
    for command in ("why-blocked", "why-slow"):
        assert main([command, path, "--task", "nobody"]) == 1
        assert capsys.readouterr().err == "error: no task of id or name nobody\n"
    assert main(["stats", path]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["polls"] == 4
    assert main(["lint", str(tmp_path / "none.log")]) == 1
    with pytest.raises(SystemExit):
        main(["diff", path])
