"""HyperLogLog++ as rows: the estimate that Spark's approx_count_distinct gives, without its buffer of all registers.

That buffer has 6.5 KB for each entity from its first value on, so a task holds it once for each of its entities. Here
an entity has a row for each register that is in use, at most 2^BITS of them, and the estimate needs only their number and
a sum over them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 2^13 registers, which approx_count_distinct takes for a relative error of 0.016
BITS = 13
M = 1 << BITS
#: up to this estimate, empty registers are counted instead
LINEAR = 6500.0
ALPHA_M2 = 0.7213 / (1 + 1.079 / M) * M * M
NEAREST = 6
#: mean raw estimates for BITS and the numbers of distinct values that they stand for (appendix of the HyperLogLog++ paper)
RAW = (
    5908.5052, 6007.2672, 6107.347, 6208.5794, 6311.2622, 6414.5514, 6519.3376, 6625.6952, 6732.5988, 6841.3552, 6950.5972, 7061.3082, 7173.5646, 7287.109,
    7401.8216, 7516.4344, 7633.3802, 7751.2962, 7870.3784, 7990.292, 8110.79, 8233.4574, 8356.6036, 8482.2712, 8607.7708, 8735.099, 8863.1858, 8993.4746,
    9123.8496, 9255.6794, 9388.5448, 9522.7516, 9657.3106, 9792.6094, 9930.5642, 10068.794, 10206.7256, 10347.81, 10490.3196, 10632.0778, 10775.9916,
    10920.4662, 11066.124, 11213.073, 11358.0362, 11508.1006, 11659.1716, 11808.7514, 11959.4884, 12112.1314, 12265.037, 12420.3756, 12578.933, 12734.311,
    12890.0006, 13047.2144, 13207.3096, 13368.5144, 13528.024, 13689.847, 13852.7528, 14018.3168, 14180.5372, 14346.9668, 14513.5074, 14677.867,
    14846.2186, 15017.4186, 15184.9716, 15356.339, 15529.2972, 15697.3578, 15871.8686, 16042.187, 16216.4094, 16389.4188, 16565.9126, 16742.3272,
    16919.0042, 17094.7592, 17273.965, 17451.8342, 17634.4254, 17810.5984, 17988.9242, 18171.051, 18354.7938, 18539.466, 18721.0408, 18904.9972, 19081.867,
    19271.9118, 19451.8694, 19637.9816, 19821.2922, 20013.1292, 20199.3858, 20387.8726, 20572.9514, 20770.7764, 20955.1714, 21144.751, 21329.9952,
    21520.709, 21712.7016, 21906.3868, 22096.2626, 22286.0524, 22475.051, 22665.5098, 22862.8492, 23055.5294, 23249.6138, 23437.848, 23636.273, 23826.093,
    24020.3296, 24213.3896, 24411.7392, 24602.9614, 24805.7952, 24998.1552, 25193.9588, 25389.0166, 25585.8392, 25780.6976, 25981.2728, 26175.977,
    26376.5252, 26570.1964, 26773.387, 26962.9812, 27163.0586, 27368.164, 27565.0534, 27758.7428, 27961.1276, 28163.2324, 28362.3816, 28565.7668,
    28758.644, 28956.9768, 29163.4722, 29354.7026, 29561.1186, 29767.9948, 29959.9986, 30164.0492, 30366.9818, 30562.5338, 30762.9928, 30976.1592,
    31166.274, 31376.722, 31570.3734, 31770.809, 31974.8934, 32179.5286, 32387.5442, 32582.3504, 32794.076, 32989.9528, 33191.842, 33392.4684, 33595.659,
    33801.8672, 34000.3414, 34200.0922, 34402.6792, 34610.0638, 34804.0084, 35011.13, 35218.669, 35418.6634, 35619.0792, 35830.6534, 36028.4966,
    36229.7902, 36438.6422, 36630.7764, 36833.3102, 37048.6728, 37247.3916, 37453.5904, 37669.3614, 37854.5526, 38059.305, 38268.0936, 38470.2516,
    38674.7064, 38876.167, 39068.3794, 39281.9144, 39492.8566, 39684.8628, 39898.4108, 40093.1836, 40297.6858, 40489.7086, 40717.2424,
)
TRUE = (
    1, 205, 410, 615, 820, 1024, 1229, 1434, 1639, 1844, 2048, 2253, 2458, 2663, 2868, 3072, 3277, 3482, 3687, 3892, 4096, 4301, 4506, 4711, 4916, 5120,
    5325, 5530, 5735, 5940, 6144, 6349, 6554, 6759, 6964, 7168, 7373, 7578, 7783, 7988, 8192, 8397, 8602, 8807, 9011, 9216, 9421, 9626, 9831, 10035, 10240,
    10445, 10650, 10855, 11059, 11264, 11469, 11674, 11879, 12083, 12288, 12493, 12698, 12903, 13107, 13312, 13517, 13722, 13927, 14131, 14336, 14541,
    14746, 14951, 15155, 15360, 15565, 15770, 15975, 16179, 16384, 16589, 16794, 16998, 17203, 17408, 17613, 17818, 18022, 18227, 18432, 18637, 18842,
    19046, 19251, 19456, 19661, 19866, 20070, 20275, 20480, 20685, 20890, 21094, 21299, 21504, 21709, 21914, 22118, 22323, 22528, 22733, 22938, 23142,
    23347, 23552, 23757, 23962, 24166, 24371, 24576, 24781, 24985, 25190, 25395, 25600, 25805, 26009, 26214, 26419, 26624, 26829, 27033, 27238, 27443,
    27648, 27853, 28057, 28262, 28467, 28672, 28877, 29081, 29286, 29491, 29696, 29901, 30105, 30310, 30515, 30720, 30925, 31129, 31334, 31539, 31744,
    31949, 32153, 32358, 32563, 32768, 32972, 33177, 33382, 33587, 33792, 33996, 34201, 34406, 34611, 34816, 35020, 35225, 35430, 35635, 35840, 36044,
    36249, 36454, 36659, 36864, 37068, 37273, 37478, 37683, 37888, 38092, 38297, 38502, 38707, 38912, 39116, 39321, 39526, 39731, 39936, 40140, 40345,
    40550, 40755,
)


def hashed(x: Column, kind: T.DataType | None) -> Column:
    return F.xxhash64(x if kind is None else _listed(x, kind))


def _listed(x: Column, kind: T.DataType) -> Column:
    """Maps as lists of their entries, which have the hash that approx_count_distinct takes of a map; xxhash64 refuses maps."""
    if "map<" not in kind.simpleString():
        return x
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return _listed(F.map_entries(x), T.ArrayType(entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: _listed(e, kind.elementType))
    return F.struct(*[_listed(x.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])


def register(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BITS).cast("int")


def height(h: Column) -> Column:
    """Place of the first bit that is set after those of the register."""
    rest = F.shiftleft(h, BITS).bitwiseOR(F.lit(1 << (BITS - 1)))
    return F.lit(65) - F.octet_length(F.bin(rest))


def share(height: Column) -> Column:
    """What a register in use adds to the sum: 2^-height."""
    return F.lit(1.0) / F.call_function("shiftleft", F.lit(1).cast("long"), height)


def bias(e: float) -> float:
    """Mean over the nearest of the table, found as approx_count_distinct does."""
    low = max(sum(x < e for x in RAW) - NEAREST + 1, 0)
    high = min(low + NEAREST, len(RAW))
    while high < len(RAW) and (e - RAW[high]) ** 2 < (e - RAW[low]) ** 2:
        low, high = low + 1, high + 1
    return sum(r - n for r, n in zip(RAW[low:high], TRUE[low:high], strict=True)) / (high - low)


def _steps() -> tuple[list[float], list[float]]:
    """The bias is constant between neighbouring places at which the nearest change: those places and the biases up to each."""
    at = sorted({*RAW, *((a + b) / 2 for a, b in zip(RAW, RAW[NEAREST:]))})
    return at, [bias((a + b) / 2) for a, b in zip([0.0, *at], [*at, 5.0 * M])]


def _doubles(xs: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'{x!r}D' for x in xs)})")


def estimate(used: Column, total: Column) -> Column:
    """Distinct values from the number of registers in use and the sum of their shares."""
    at, biases = _steps()
    empty = F.lit(float(M)) - used
    e = F.lit(ALPHA_M2) / (empty + total)
    linear = F.lit(float(M)) * F.log(F.lit(float(M)) / F.greatest(empty, F.lit(1.0)))
    near = e - F.element_at(_doubles(biases), F.size(F.filter(_doubles(at), lambda x: x < e)) + 1)
    found = F.when((empty > 0) & ((linear <= LINEAR) | (e <= 2.5 * M)), linear).when(e < 5.0 * M, near).otherwise(e)
    return F.floor(found + 0.5).cast("long")
