"""Late verdicts into stored mails."""

import json

from certloom.streaming import verdicts as V


def test_late_confirmations(spark, tmp_path):
    base = spark.createDataFrame([(1, "a.com", ["x.top", "y.top"], [], "clean", []), (2, "x.top", [], ["spf_fail"], "suspicious", []), (3, "c.com", None, [], "clean", []), (4, None, [], [], "clean", [])], V.MAILS)
    (tmp_path / "in").mkdir()
    folder = str(tmp_path / "mails")

    def turn(k, rows):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"site": s, "at": t}) for s, t in rows))
        V.rejudge(spark.readStream.schema("site string, at long").json(str(tmp_path / "in")), base, folder, str(tmp_path / "cp")).awaitTermination()
        return {r.mail: (r.signals, r.verdict, [tuple(h) for h in r.history]) for r in V.current(base, folder).collect()}

    first = turn(0, [("x.top", 10), ("x.top", 11), (None, 1)])
    assert first[1] == (["link_domain_confirmed"], "suspicious", [(10, "clean", "suspicious")])
    assert first[2] == (["sender_domain_confirmed", "spf_fail"], "suspicious", []) and first[3][1] == first[4][1] == "clean"
    second = turn(1, [("a.com", 20), ("y.top", 21)])
    assert second[1] == (["link_domain_confirmed", "sender_domain_confirmed"], "malicious", [(10, "clean", "suspicious"), (20, "suspicious", "malicious")])
    # the second batch tried again: the same rows from the same state before it
    again = spark.createDataFrame([("a.com", 20), ("y.top", 21)], "site string, at long")
    rows = V.changes(V.current(base, folder, 1), again).collect()
    assert [(r.mail, r.verdict, len(r.history)) for r in rows] == [(1, "malicious", 2)]
    assert turn(2, [("x.top", 30)]) == second
