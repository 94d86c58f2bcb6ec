import math
import random

import pytest

from tessera.operators.join import join
from tessera.plans.sqltext import SqlDataError

NAN = math.nan


def rows(df):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def basic(spark):
    left = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "c"), (3.0, "d")], "id double, name string")
    right = spark.createDataFrame([(2.0, 20.0), (3.0, 30.0), (5.0, 50.0)], "id double, score double")
    return left, right


def test_modes(basic):
    left, right = basic
    assert rows(join(left, right, "id")) == [(2.0, "b", 20.0), (3.0, "c", 30.0), (3.0, "d", 30.0)]
    assert rows(join(left, right, "id", "left")) == [(1.0, "a", "nan"), (2.0, "b", 20.0), (3.0, "c", 30.0), (3.0, "d", 30.0)]
    assert (5.0, "NA", 50.0) in rows(join(left, right, "id", "full")) and join(left, right, "id", "full").count() == 5
    assert (5.0, 50.0, "NA") in rows(join(right, left, "id", "left"))
    assert [r.id for r in join(left, right, "id", "full", order_by=("id", "id")).collect()] == [1, 2, 3, 3, 5]


def test_nan_keys_and_empty_sides(spark, basic):
    left = spark.createDataFrame([(1.0,), (NAN,), (2.0,)], "id double")
    right = spark.createDataFrame([(NAN, 999.0), (2.0, 20.0)], "id double, score double")
    assert join(left, right, "id").count() == 1
    assert join(left, right, "id", "full").count() == 4
    none = basic[1].limit(0)
    assert [join(basic[0], none, "id", how).count() for how in ("inner", "left", "full")] == [0, 4, 4]


def test_collisions_strings_and_contract(spark, basic):
    a = spark.createDataFrame([(1, 10), (2, 20)], "id int, value int")
    b = spark.createDataFrame([(1, 100), (2, 200)], "id int, value int")
    assert join(a, b, "id").columns == ["id", "value", "value_right"]
    s = spark.createDataFrame([("alice", 30.0), ("bob", 40.0), ("carol", 50.0)], "name string, age double")
    t = spark.createDataFrame([("bob", 1.0), ("dave", 2.0)], "name string, city_code double")
    assert ("dave", "nan", 2.0) in rows(join(s, t, "name", "full"))
    for bad in (lambda: join(s, basic[1], "name"), lambda: join(s, basic[0], "id"), lambda: join(s, basic[0].withColumnRenamed("id", "age").select("age", "name"), "name", "right")):
        with pytest.raises((SqlDataError, ValueError)):
            bad()
    with pytest.raises(SqlDataError):
        join(s.withColumnRenamed("name", "k"), basic[1].withColumnRenamed("id", "k"), "k")


def test_fuzz_against_loops(spark):
    rnd = random.Random(3)
    left = [(rnd.choice([1.0, 2.0, 3.0, NAN]), float(i)) for i in range(30)]
    right = [(rnd.choice([2.0, 3.0, 4.0, NAN]), float(i)) for i in range(20)]
    a, b = spark.createDataFrame(left, "k double, x double"), spark.createDataFrame(right, "k double, y double")
    inner = [(k, x, y) for k, x in left for q, y in right if k == q]
    lone = [(k, x, "nan") for k, x in left if not any(k == q for q, _ in right)]
    drained = [(q, "nan", y) for q, y in right if not any(k == q for k, _ in left)]
    plain = lambda rs: sorted((tuple("nan" if v != v else v for v in r) for r in rs), key=repr)
    assert rows(join(a, b, "k")) == plain(inner)
    assert rows(join(a, b, "k", "left")) == plain(inner + lone)
    assert rows(join(a, b, "k", "full")) == plain(inner + lone + drained)
