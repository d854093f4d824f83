"""Imaging-metadata archive operations on Spark DataFrames."""

from scanloom.session import archive_session, settle, work_dir

__all__ = ["archive_session", "settle", "work_dir"]
