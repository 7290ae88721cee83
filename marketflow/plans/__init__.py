"""Registered queries; importing a module registers its queries."""
