"""Column functions: text, ages, times, dates, prices, phrases, calendars."""
