"""Schemas of the tables the engine reads and writes."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField,
    StructType, TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


PART = _struct(
    part_id=StringType(), part_ord=LongType(), part_name=StringType(),
    part_code=StringType(), keywords=StringType(),
)
CARD = _struct(
    part_id=StringType(), card_ord=IntegerType(), title_raw=StringType(), price_raw=LongType(),
    price_text=StringType(), currency_unit=StringType(), seller_name=StringType(),
    product_url=StringType(), seller_url=StringType(), availability=StringType(),
    snapshot_ts=TimestampType(),
)
PRODUCT_JSON = _struct(
    name1=StringType(), name2=StringType(), price=StringType(), price_text=StringType(),
    web_client_absolute_url=StringType(), shop_text=StringType(), stock_status=StringType(),
)
PAGE = _struct(page_id=LongType(), url=StringType(), html=StringType())
PAGE_OFFER = _struct(
    product_url=StringType(), offer_pos=IntegerType(), seller_name=StringType(),
    price_raw=LongType(), price_text=StringType(), currency_unit=StringType(),
    seller_url=StringType(), availability=StringType(),
)
SNAPSHOT = _struct(
    cache_type=StringType(), cache_key=StringType(), query=StringType(),
    cached_at=TimestampType(),
    data=ArrayType(StructType([f for f in CARD if f.name not in ("part_id", "card_ord")])),
)
ALIAS = _struct(variation=StringType(), canonical=StringType())
OFFERS_RAW_V2 = _struct(
    part_id=StringType(), part_name=StringType(), part_code=StringType(), query=StringType(),
    part_key=StringType(), part_name_norm=StringType(), title_raw=StringType(),
    price_raw=LongType(), price_text=StringType(), currency_unit=StringType(),
    seller_name=StringType(), seller_name_norm=StringType(), price_toman=LongType(),
    price_rial=LongType(), product_url=StringType(), seller_url=StringType(),
    validation_urls=StringType(), relevance=DoubleType(), snapshot_ts=TimestampType(),
    price_missing=IntegerType(), drilled_down=BooleanType(),
)
