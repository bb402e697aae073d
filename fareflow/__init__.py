"""Booking-cancellation analytics written as PySpark DataFrame programs."""
