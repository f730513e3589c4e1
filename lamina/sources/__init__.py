"""Sources and sinks: XML documents as node tables, files, stores."""
