"""Readers: XYZ files, NMEA logs and magnetometer logs, from tables of numbered lines (lines.read_lines)."""
