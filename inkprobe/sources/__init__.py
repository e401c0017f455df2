"""Readers: papers from documents, cells from messy tables, posts from feeds and replies, rules, reports."""
