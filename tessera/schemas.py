"""Declared schemas of the records the operators read and write."""

from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

REVIEW = StructType(
    [
        StructField("review_id", StringType()),
        StructField("user_id", StringType()),
        StructField("business_id", StringType()),
        StructField("stars", DoubleType()),
        StructField("date", StringType()),
        StructField("text", StringType()),
    ]
)
BUSINESS = StructType(
    [StructField("business_id", StringType()), StructField("categories", StringType()), StructField("state", StringType())]
)
#: Basket items are text: itemsets are ordered as text, so "100" stands before "97".
BASKET = StructType([StructField("basket", StringType()), StructField("item", StringType())])
ITEM_MODEL = StructType([StructField("b1", StringType()), StructField("b2", StringType()), StructField("sim", DoubleType())])
USER_MODEL = StructType([StructField("u1", StringType()), StructField("u2", StringType()), StructField("sim", DoubleType())])
PROFILE_MODEL = StructType(
    [
        StructField("type", StringType()),
        StructField("profile_id", StringType()),
        StructField("profile_vector", ArrayType(StringType())),
    ]
)
POINT = StructType([StructField("point_id", LongType()), StructField("features", ArrayType(DoubleType()))])
