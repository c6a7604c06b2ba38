import pytest
from pyspark.sql import functions as F

from spanveil.operators import policy
from spanveil.operators.policy import Policy
from spanveil.sources import policy_store, selection, versions

SCHEMA = "k string, v int"


def present(spark, path):
    return sorted(map(tuple, versions.read(spark, path, SCHEMA, "k").collect()), key=repr)


def test_save_change_compact_remove(spark, tmp_path):
    path = str(tmp_path / "t")
    assert present(spark, path) == []
    assert versions.replace(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], SCHEMA), path) == 1
    versions.change(spark.createDataFrame([("b", 20), ("c", 4), (None, 30)], SCHEMA), path)
    versions.change(spark.createDataFrame([("c", 40)], SCHEMA), path)
    want = [("a", 1), ("b", 20), ("c", 40), (None, 30)]
    assert present(spark, path) == sorted(want, key=repr)
    assert versions.compact(spark, path, SCHEMA, "k") == 4
    assert len(versions.remove_old(spark, path)) == 3 and present(spark, path) == sorted(want, key=repr)
    # In place: what is read is not what is written.
    versions.replace(versions.read(spark, path, SCHEMA, "k").filter("v < 30"), path)
    assert present(spark, path) == [("a", 1), ("b", 20)]
    versions.replace(spark.createDataFrame([], SCHEMA), path)
    assert present(spark, path) == []


def test_a_save_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.replace(spark.createDataFrame([("a", 1)], SCHEMA), path)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(versions, "publish", dies)
        with pytest.raises(KeyboardInterrupt):
            versions.replace(spark.createDataFrame([("a", 2)], SCHEMA), path)
    assert present(spark, path) == [("a", 1)]
    bad = spark.createDataFrame([("a", 3)], SCHEMA).withColumn("v", F.expr("if(v = 3, raise_error('no'), v)"))
    with pytest.raises(Exception, match="no"):
        versions.replace(bad, path)
    assert present(spark, path) == [("a", 1)]
    versions.replace(spark.createDataFrame([("a", 4)], SCHEMA), path)
    assert present(spark, path) == [("a", 4)]
    versions.remove_old(spark, path)
    assert len(list((tmp_path / "t").glob("save=*"))) == 1


def test_settings_keep_unknown_keys(spark, tmp_path):
    path = str(tmp_path / "settings")
    texts = [("t1", '{"z": {"b": [1, null, "x"]}, "a \\"q\\"": "é", "confidence_threshold": "0.7", "history_limit": 0}'),
             ("t2", "nothing"), ("t3", '{"entities": {"URL": true}, "keep_history": "false"}')]
    frame = spark.createDataFrame(texts, "tenant string, settings string")
    policy_store.save_settings(policy.read_settings(frame, keep_unknown=True), path)
    rows = {r["tenant"]: r for r in policy_store.load_settings(spark, path).collect()}
    assert rows["t1"]["other"] == {"z": '{"b":[1,null,"x"]}', 'a "q"': '"é"'}
    assert (rows["t1"]["confidence_threshold"], rows["t1"]["history_limit"]) == (0.7, 1)
    assert rows["t2"]["other"] == {} and rows["t3"]["keep_history"] is False and rows["t3"]["entities"]["URL"]
    policy_store.update_settings(spark.createDataFrame([("t2", '{"own": 1}')], "tenant string, settings string"), path)
    again = {r["tenant"]: r for r in policy_store.load_settings(spark, path).collect()}
    assert again["t2"]["other"] == {"own": "1"} and again["t1"] == rows["t1"] and len(again) == 3


def test_pointer_of_one_owner(spark, tmp_path):
    path = str(tmp_path / "pointers")
    for owner, record in [("u", "r1"), ("v", "q1"), ("u", "r2")]:
        selection.select_record(spark, path, "owner", owner, record)
    rows = {r["owner"]: r["selected_id"] for r in selection.saved_pointers(spark, path, "owner").collect()}
    assert rows == {"u": "r2", "v": "q1"}


def test_scalars_saved_as_text():
    saved = '{"confidence_threshold": "0.75", "keep_history": "false", "history_limit": "7", "language": 5, "scan_enabled": null}'
    own = Policy.from_json(saved)
    assert (own.confidence_threshold, own.keep_history, own.history_limit, own.language, own.scan_enabled) == (
        0.75, False, 7, "en", True)
    for bad in ('"high"', "[1]", "null", '"nan"', "{}"):
        assert Policy.from_json(f'{{"confidence_threshold": {bad}, "history_limit": {bad}}}') == Policy()
    assert Policy.from_json('{"history_limit": -5}').history_limit == 1
