"""Logical bindings of tables to tracks."""
