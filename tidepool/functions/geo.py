"""Distances on the sphere, in miles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The two radii in use.
RADIUS, LEGACY_RADIUS = 3958.7613, 3959.0


def _h(a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> Column:
    return F.pow(F.sin(F.radians(b_lat - a_lat) / 2), 2) + F.cos(F.radians(a_lat)) * F.cos(F.radians(b_lat)) * F.pow(F.sin(F.radians(b_lng - a_lng) / 2), 2)


def haversine(a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> Column:
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(_h(a_lat, a_lng, b_lat, b_lng))))


def haversine_legacy(a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> Column:
    h = _h(a_lat, a_lng, b_lat, b_lng)
    return 2 * LEGACY_RADIUS * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def valid_point(lat: Column, lng: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lng), F.lit(False))


def within(lat: Column, lng: Column, center_lat: float, center_lng: float, miles: float) -> Column:
    """Valid points at most so far from the centre: a box of degrees first, the sphere after."""
    if not (-90 <= center_lat <= 90 and -180 <= center_lng <= 180):
        raise ValueError("centre is no point on the sphere")
    if miles < 0:
        return F.lit(False)
    box = F.abs(lat - center_lat) <= miles / 69.0 + 0.01
    return valid_point(lat, lng) & box & (haversine(lat, lng, F.lit(center_lat), F.lit(center_lng)) <= miles)
