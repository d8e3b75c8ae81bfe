"""Gradient-boosted trees and the analytics around them, as Spark DataFrame plans."""
