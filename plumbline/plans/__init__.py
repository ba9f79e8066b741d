"""Registered queries; importing `every` fills the catalogue."""
