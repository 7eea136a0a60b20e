"""Places within a distance, against all pairs: round the date line and at the poles too."""

import math
import random

import pytest

from casewright.operators import joins as j

R = 6371.0088


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("reach", [0.05, 30.0, 400.0, 3000.0, 12000.0])
def test_pairs_are_those_of_all_pairs(spark, reach):
    rng = random.Random(7)
    spread = min(60.0, 3 * math.degrees(reach / R))
    homes = [(0, 0), (52, 13), (-33, 151), (10, 179.99), (-10, -179.99), (89.5, 40), (-89.9, 0), (75, 180), (90, 0), (-90, 77)]
    places = []
    for k in range(260):
        lat, lon = rng.choice(homes)
        lat = max(-90.0, min(90.0, lat + rng.uniform(-spread, spread)))
        places.append((k, lat, (lon + rng.uniform(-spread, spread) / max(0.02, math.cos(math.radians(lat))) + 180) % 360 - 180))
    places += [(900, 90.0, 10.0), (901, 90.0, -170.0), (902, 0.0, 180.0), (903, 0.0, -180.0), (904, None, 1.0), (905, 1.0, None)]
    got = {(r.a, r.b) for r in j.within_km(spark.createDataFrame(places, "id long, lat double, lon double"), "id", reach, R).collect()}
    sound = [p for p in places if None not in p]
    far = {(a[0], b[0]): km(a, b) for a in sound for b in sound if a[0] < b[0]}
    assert got == {p for p, d in far.items() if d <= reach} or all(abs(far[p] - reach) < 1e-6 for p in got ^ {p for p, d in far.items() if d <= reach})
    assert (900, 901) in got and (902, 903) in got
