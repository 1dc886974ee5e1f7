"""Spark-native audit of customer rewards against play."""

from floorledger.ledgers import Ledgers

__all__ = ["Ledgers"]
