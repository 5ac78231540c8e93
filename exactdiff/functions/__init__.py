"""Column functions: text, dates and the checks that explain why two unequal texts look related."""
