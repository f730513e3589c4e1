"""Relational operators over nodes, edges, trees, histories and indexes."""
