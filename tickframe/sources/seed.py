"""The default ticker universe, for a lakehouse without its own configuration.

Fixed values: symbols, companies and sectors of the universe in order of
ingestion, and the coarser sectors of the analytics mapping where they differ.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tickframe.schemas import SECTOR_MAP, TICKER_CONFIG

SUFFIX = ".NS"

UNIVERSE = [
    ("HDFCBANK", "HDFC Bank Limited", "Financial Services"),
    ("ICICIBANK", "ICICI Bank Limited", "Financial Services"),
    ("KOTAKBANK", "Kotak Mahindra Bank Limited", "Financial Services"),
    ("AXISBANK", "Axis Bank Limited", "Financial Services"),
    ("SBIN", "State Bank of India", "Financial Services"),
    ("BAJFINANCE", "Bajaj Finance Limited", "Financial Services"),
    ("BAJAJFINSV", "Bajaj Finserv Limited", "Financial Services"),
    ("SBILIFE", "SBI Life Insurance Company Limited", "Financial Services"),
    ("HDFCLIFE", "HDFC Life Insurance Company Limited", "Financial Services"),
    ("INDUSINDBK", "IndusInd Bank Limited", "Financial Services"),
    ("TCS", "Tata Consultancy Services Limited", "IT Services"),
    ("INFY", "Infosys Limited", "IT Services"),
    ("HCLTECH", "HCL Technologies Limited", "IT Services"),
    ("WIPRO", "Wipro Limited", "IT Services"),
    ("TECHM", "Tech Mahindra Limited", "IT Services"),
    ("RELIANCE", "Reliance Industries Limited", "Oil & Gas"),
    ("ONGC", "Oil and Natural Gas Corporation Limited", "Oil & Gas"),
    ("BPCL", "Bharat Petroleum Corporation Limited", "Oil & Gas"),
    ("HINDUNILVR", "Hindustan Unilever Limited", "FMCG"),
    ("ITC", "ITC Limited", "FMCG"),
    ("NESTLEIND", "Nestle India Limited", "FMCG"),
    ("BRITANNIA", "Britannia Industries Limited", "FMCG"),
    ("TATACONSUM", "Tata Consumer Products Limited", "FMCG"),
    ("SUNPHARMA", "Sun Pharmaceutical Industries Limited", "Pharma"),
    ("DRREDDY", "Dr. Reddys Laboratories Limited", "Pharma"),
    ("CIPLA", "Cipla Limited", "Pharma"),
    ("DIVISLAB", "Divis Laboratories Limited", "Pharma"),
    ("APOLLOHOSP", "Apollo Hospitals Enterprise Limited", "Healthcare"),
    ("MARUTI", "Maruti Suzuki India Limited", "Auto"),
    ("TATAMOTORS", "Tata Motors Limited", "Auto"),
    ("M&M", "Mahindra & Mahindra Limited", "Auto"),
    ("BAJAJ-AUTO", "Bajaj Auto Limited", "Auto"),
    ("EICHERMOT", "Eicher Motors Limited", "Auto"),
    ("HEROMOTOCO", "Hero MotoCorp Limited", "Auto"),
    ("TATASTEEL", "Tata Steel Limited", "Metals & Mining"),
    ("HINDALCO", "Hindalco Industries Limited", "Metals & Mining"),
    ("JSWSTEEL", "JSW Steel Limited", "Metals & Mining"),
    ("COALINDIA", "Coal India Limited", "Metals & Mining"),
    ("ULTRACEMCO", "UltraTech Cement Limited", "Cement"),
    ("SHREECEM", "Shree Cement Limited", "Cement"),
    ("GRASIM", "Grasim Industries Limited", "Cement"),
    ("BHARTIARTL", "Bharti Airtel Limited", "Telecom"),
    ("NTPC", "NTPC Limited", "Power"),
    ("POWERGRID", "Power Grid Corporation of India Limited", "Power"),
    ("LT", "Larsen & Toubro Limited", "Engineering & Construction"),
    ("ADANIPORTS", "Adani Ports and Special Economic Zone Limited", "Infrastructure"),
    ("ADANIENT", "Adani Enterprises Limited", "Diversified"),
    ("ASIANPAINT", "Asian Paints Limited", "Consumer Goods"),
    ("TITAN", "Titan Company Limited", "Consumer Goods"),
    ("UPL", "UPL Limited", "Agrochemicals"),
]

ANALYTICS_SECTORS = {
    "APOLLOHOSP": "Pharma",
    "NTPC": "Infrastructure",
    "POWERGRID": "Infrastructure",
    "LT": "Infrastructure",
    "ADANIENT": "Infrastructure",
    "ASIANPAINT": "Consumer Durables",
    "TITAN": "Consumer Durables",
    "UPL": "Agro Chemicals",
}


def default_config(spark: SparkSession, at: datetime) -> DataFrame:
    rows = [
        (i, symbol + SUFFIX, symbol, company, sector, True, at.date(), at)
        for i, (symbol, company, sector) in enumerate(UNIVERSE, 1)
    ]
    return spark.createDataFrame(rows, TICKER_CONFIG)


def default_sector_map(spark: SparkSession) -> DataFrame:
    rows = [(symbol, ANALYTICS_SECTORS.get(symbol, sector)) for symbol, _, sector in UNIVERSE]
    return spark.createDataFrame(rows, SECTOR_MAP)


def config_or_default(spark: SparkSession, table: str, at: datetime) -> DataFrame:
    """The configured universe, or the default one where no table exists."""
    return spark.table(table) if spark.catalog.tableExists(table) else default_config(spark, at)
