import pytest
from pyspark.sql import functions as F

from fieldmill.functions import rooms

PARTS = "1-Wood House: 1-Bed, 1-Bath\n6-Unit Rooms: 1-Bed, 1-Bath each"
VILLA = "Private 7-Bedroom villa complex\n7 Bedrooms, 8 Bathrooms\nMain 3-Bedroom Villa\nTwo bungalows - 4 additional Bedrooms\n$2,500 per month"
# text, bedrooms, bathrooms, conflict of each
CASES = [
    ("3 bedrooms", 3, None, False, False), ("2- Bedrooms", 2, None, False, False), ("Number of bedrooms: 4\r\nNumber of bathrooms: 5", 4, 5, False, False),
    ("2BR", 2, None, False, False), ("Bedroom 02\nBathroom 03", 2, 3, False, False), ("Bedroom 3 Bathroom 2", 3, 2, False, False),
    ("for rent $450 3 bedrooms 2 bathrooms", 3, 2, False, False), ("Two bedrooms, three bathrooms", 2, 3, False, False),
    ("Bedroom twenty-one, Bathroom two", 21, 2, False, False), ("seventeen bedrooms", 17, None, False, False),
    ("• Layout: 3 Bed | 4 Bath | Kitchen", 3, 4, False, False), ("3 Bed | 4 Bath", 3, 4, False, False), ("Layout: 3 bed frames included", None, None, False, False),
    ("2 beds, sofa bed", None, None, False, False), ("2-Bedroom House\nLayout: 3 Bed | 4 Bath", None, 4, True, False),
    (PARTS, None, None, False, False), ("7 Bedrooms, 7 Bathrooms\n" + PARTS, 7, 7, False, False), (f"7 Bathrooms\n{PARTS}\nOverall: 8 Bathrooms", None, None, False, True),
    ("Bedrooms: 4 + 1", None, None, True, False), ("4+1 bedrooms", None, None, True, False), ("បន្ទប់គេង 4+1", None, None, True, False),
    ("បន្ទប់គេង 2\nបន្ទប់ទឹក 3", 2, 3, False, False), ("០២ បន្ទប់គេង, បន្ទប់ទឹក ០៣", 2, 3, False, False), ("បន្ទប់គេង\u200b ០២\nបន្ទប់ទឹក\u200b០៣", 2, 3, False, False),
    ("Studio apartment", 0, None, False, False), ("2 Bedrooms\nBedrooms: 3\n1 bathroom\n2 baths", None, None, True, True), ("40 bedrooms", None, None, False, False),
    (VILLA, 7, 8, False, False), (VILLA.replace("7 Bedrooms", "6 Bedrooms").replace("7-Bedroom", "6-Bedroom"), None, 8, True, False),
    (VILLA.replace("4 additional Bedrooms", "4 Bedrooms"), None, 8, True, False), (VILLA + "\nGuest unit: 2 Bedrooms", None, 8, True, False),
    (None, None, None, False, False), ("", None, None, False, False),
]


def test_room_counts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = {r["i"]: tuple(r["r"]) for r in df.select("i", rooms.room_counts(F.col("t")).alias("r")).collect()}
    assert [(c[0], got[i]) for i, c in enumerate(CASES)] == [(c[0], c[1:]) for c in CASES]


@pytest.mark.parametrize(("text", "count", "want"), [("A 3 bedrooms 2 bathrooms flat", 4, "A 4 bedrooms 2 bathrooms flat"), ("Bedrooms: 3, quiet", None, ", quiet"), ("two-bedroom house", 12, "12-bedroom house")])
def test_claims(spark, text, count, want):
    assert spark.range(1).select(rooms.claims_kept(F.lit(text), "bed", F.lit(count).cast("int"))).first()[0] == want
