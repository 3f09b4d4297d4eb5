import numpy as np
import pytest

from hemline.functions import fixed, pixels
from hemline.operators import images

RNG = np.random.default_rng(1)
IMG = RNG.integers(0, 256, (12, 10, 3)).astype(float)


def apply(name, a=IMG):
    for kernel, value in fixed.TRANSFORMS[name]:
        a = pixels.KERNELS[kernel](a, value)
    return a


@pytest.mark.parametrize("name", list(fixed.TRANSFORMS))
def test_every_transform_keeps_shape_and_range(name):
    out = apply(name)
    assert out.shape == IMG.shape and out.min() >= 0 and out.max() <= 255


def test_invariants():
    assert (apply("horizontal_flip", apply("horizontal_flip")) == IMG).all()
    assert apply("brightness_high").mean() > IMG.mean() > apply("brightness_low").mean()
    assert apply("contrast_high").std() > IMG.std() > apply("contrast_low").std()
    assert apply("blur_light").std() < IMG.std()
    flat = np.full((9, 9, 3), 100.0)
    for name in ("contrast_high", "saturation_high", "blur_medium", "sharp", "zoom_in"):
        assert (apply(name, flat) == flat).all()
    white = np.full((9, 9, 3), 255.0)
    assert (apply("rotate_10", white) == white).all()
    warm = apply("warm_tone", flat)[0, 0]
    assert tuple(warm) == (115.0, 105.0, 100.0)
    assert (pixels.rotate(IMG, 0) == IMG).all() and (pixels.resize(IMG, 12, 10) == IMG).all()
    assert (apply("zoom_out")[0] == 255).all()


def test_decode_orders_channels():
    assert pixels.decode(1, 1, 3, bytes([1, 2, 3])).ravel().tolist() == [3, 2, 1]
    assert pixels.decode(1, 1, 4, bytes([1, 2, 3, 9])).ravel().tolist() == [3, 2, 1]
    assert pixels.decode(1, 1, 1, bytes([5])).ravel().tolist() == [5, 5, 5]
    assert pixels.decode(-1, -1, -1, b"") is None


def frame(spark, n=200):
    data = [(i, 4, 3, 3, bytearray(range(36))) for i in range(n)] + [(n, -1, -1, -1, bytearray())]
    return spark.createDataFrame(data, "id int, width int, height int, n_channels int, data binary")


def test_random_augmentation_is_repeatable(spark):
    from pyspark.sql import functions as F

    plan = images.random_plan(frame(spark), "strong", F.col("id"))
    a = images.augment_random(plan).orderBy("id").collect()
    b = images.augment_random(plan.repartition(7)).orderBy("id").collect()
    assert [r.pixels for r in a] == [r.pixels for r in b] and a[-1].pixels is None
    rotated = [r for r in a if r.angle is not None]
    assert 0.35 < len(rotated) / len(a) < 0.65 and all(abs(r.angle) <= 30 for r in rotated)
    none = images.augment_random(images.random_plan(frame(spark, 3), "none", F.col("id"))).first()
    assert list(none.pixels[:3]) == [2, 1, 0]


def test_prepare_images(spark):
    rows = images.prepare_images(frame(spark, 1), 2).orderBy("id").collect()
    assert rows[0].ok and len(rows[0]["values"]) == 12 and -1 <= min(rows[0]["values"]) <= max(rows[0]["values"]) <= 1
    assert not rows[1].ok and set(rows[1]["values"]) == {0.0}
