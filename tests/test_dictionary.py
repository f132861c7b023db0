"""Growing dictionaries: increments, pinned readers, compaction, commits."""
import pytest

from tagflow.operators.dictionary import GrowingDictionary
from tagflow.session import scratch

RESERVED = {"<UNK>": 0, "<PAD>": 1}


def words(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "key string")


def content(df):
    return {r.key: r.id for r in df.collect()}


def test_increments_keep_ids_and_pinned_readers_their_version(spark):
    d = GrowingDictionary.create(spark, scratch(spark, "test-dict"), RESERVED)
    assert d.add(words(spark, "b", "a", "b", None, "<PAD>")) == 1
    pinned = d.read(1)
    assert d.add(words(spark, "c", "a", "Z")) == 2
    assert content(d.read()) == {**RESERVED, "a": 2, "b": 3, "Z": 4, "c": 5}
    assert content(d.read(1)) == content(pinned) == {**RESERVED, "a": 2, "b": 3} and content(d.read(0)) == RESERVED
    d.compact()
    d.compact()
    assert d.add(words(spark, "d", "c")) == 3
    assert content(d.read()) == {**RESERVED, "a": 2, "b": 3, "Z": 4, "c": 5, "d": 6}
    assert content(d.read(1)) == content(pinned) == {**RESERVED, "a": 2, "b": 3} and content(d.read(2))["c"] == 5
    with pytest.raises(ValueError):
        d.read(9)


def test_two_increments_equal_one_build_up_to_the_order(spark):
    import random
    draw = random.Random(1)
    one, two = [[f"w{draw.randint(0, 500)}" for _ in range(300)] for _ in range(2)]
    d = GrowingDictionary.create(spark, scratch(spark, "test-dict"), RESERVED)
    d.add(words(spark, *one).repartition(5))
    d.add(words(spark, *two).repartition(3))
    e = GrowingDictionary.create(spark, scratch(spark, "test-dict"), RESERVED)
    e.add(words(spark, *one, *two))
    a, b = content(d.read()), content(e.read())
    assert a.keys() == b.keys() and sorted(a.values()) == sorted(b.values()) == list(range(len(a)))
    assert [w for w in sorted(a, key=a.get)][2:] == sorted(set(one)) + sorted(set(two) - set(one))


def test_empty_increment_and_lost_race(spark, monkeypatch):
    d = GrowingDictionary.create(spark, scratch(spark, "test-dict"), RESERVED)
    assert d.add(words(spark).limit(0)) == 1 and content(d.read()) == RESERVED
    monkeypatch.setattr(GrowingDictionary, "version", property(lambda self: 0))  # another writer committed meanwhile
    with pytest.raises(FileExistsError):
        d.add(words(spark, "x"))
    monkeypatch.undo()
    assert content(d.read()) == RESERVED
    with pytest.raises(FileExistsError):
        GrowingDictionary.create(spark, d.path, RESERVED)
