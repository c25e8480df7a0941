"""Part of vellumspark; see the modules."""
